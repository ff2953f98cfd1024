"""Alignment of two tokenizers over the same texts, and how often their tokens meet.

Tokenizer A is a byte-level BPE, B a BPE over pieces with byte fallback that puts a
space in front; A gets the text with that space. Both cut the same bytes, and where
both end a token a group ends. The common ends come from a galloping intersection:
each end of the shorter list searches the longer one from the start of its text,
doubling its steps, then halving them (all ends of a slice of texts in step). The
places of the common ends slice the groups, and differences of places say how many
tokens of each side a group holds. All tokens of a group are linked in pairs.

The corpus-wide count of a pair is the number of rows whose text links it. Texts are
encoded once; ids and group sizes are stored, and counted from there: distinct pairs
are summed up in each slice, then by Spark. The counts go back to the texts through a
table of the most frequent pairs, of at most ``MOST_PAIRS`` rows; pairs beyond it are
joined by a shuffle, so nothing is left out.

Null and empty texts, and those whose bytes a tokenizer changes, have no tokens:
zeros, and no groups. Repeated rows are documents each; ties for the highest count of
an A token are all highest. An empty table gives an empty one. A very long text is a
slice of its own, about 200 bytes of memory for each of its bytes in one task. Only
the id and text columns are read, so others may have any name.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textio import buffers, map_texts, small_batches, stored

#: Rows of the table of pairs that every task gets: at most 24 MB.
MOST_PAIRS = 2_000_000
#: Groups with more links than this are reduced to their different tokens before pairs are made.
WIDE = 4096
#: Ends of the shorter list that share a start of their search.
FINGER = 8
#: In a packed list of tokens, marks the last token of a group.
END = 1 << 31
#: Bytes of a row group of packed tokens: what a reader holds at once.
ROW_GROUP = 1 << 23
#: A's ranks and its own library agree on texts of Latin letters (UTF-8 bytes below this) without such long white space; others take the library.
LATIN, BLANKS = 0xC9, 400
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0xC2]] = True


def byte_of_char() -> dict[str, int]:
    """The bytes that the characters of a byte-level vocabulary stand for: printable ones for themselves, the others in order from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class ByteTokenizer:
    """A: encodes texts, and knows the number of bytes of each id."""

    def __init__(self, path: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        byte = byte_of_char()
        ranks = {bytes(byte[c] for c in token): k for token, k in model["vocab"].items()}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        if any(model["vocab"].get(a + b) != 256 + k for k, (a, b) in enumerate(merges)):
            raise ValueError("ids do not follow the order of the merges")
        self.size = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, k in ranks.items():
            self.size[k] = len(token)
        self.fast = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True

    def encode(self, text: str, plain: bool) -> list[int]:
        return self.fast.encode_ordinary(text) if plain else self.whole.encode(text, add_special_tokens=False).ids



class PieceTokenizer:
    """B: encodes texts, and knows the bytes of each id."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(k) for k in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        self.size = np.array([len(b) for b in self.bytes], np.int64)

    def spells(self, ids: list[int], raw: bytes) -> bool:
        """Whether the pieces are these bytes."""
        return b"".join(map(self.bytes.__getitem__, ids)) == raw


def plain_texts(texts: pa.Array) -> np.ndarray:
    """Which texts have Latin letters and short white space only."""
    raw, off = buffers(texts)
    odd = raw >= LATIN
    blank = np.concatenate([[False], _BLANK[raw], [False]])
    edge = np.flatnonzero(blank[1:] != blank[:-1])
    first, end = edge[::2], edge[1::2]
    odd[first[end - first >= BLANKS]] = True
    count = np.concatenate([[0], np.cumsum(odd)])
    return count[off[1:]] == count[off[:-1]]


def gallop(keys: np.ndarray, start: np.ndarray, line: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """For each key the first place of ``line`` from ``start`` on that holds a value of at least the key.

    line is sorted within [start, stop), which ends with a value that no key exceeds.
    Doubling steps from the start, then a binary search in the last step.
    """
    low, high, step = start - 1, np.minimum(start, stop - 1), np.ones(len(keys), np.int64)
    todo = np.flatnonzero(line[high] < keys)
    while len(todo):
        low[todo] = high[todo]
        step[todo] *= 2
        high[todo] = np.minimum(high[todo] + step[todo], stop[todo] - 1)
        todo = todo[line[high[todo]] < keys[todo]]
    todo = np.flatnonzero(high - low > 1)
    while len(todo):
        mid = (low[todo] + high[todo]) >> 1
        less = line[mid] < keys[todo]
        low[todo[less]], high[todo[~less]] = mid[less], mid[~less]
        todo = todo[high[todo] - low[todo] > 1]
    return high


def starts(n: np.ndarray) -> np.ndarray:
    return np.cumsum(n) - n


def found_at(keys: np.ndarray, start: np.ndarray, line: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """``gallop`` for sorted keys: every ``FINGER``-th one first, the others from where the one before them of these was found."""
    if len(keys) > FINGER:
        finger = found_at(keys[::FINGER], start[::FINGER], line, stop[::FINGER])
        start = np.maximum(start, np.repeat(finger, FINGER)[: len(keys)])
    return gallop(keys, start, line, stop)


def common_ends(a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, place in a and place in b of all common ends. a, b: the sorted ends of each text, one text after another; n_a, n_b: how many each has."""
    found = []
    for first, (x, nx), (y, ny), swap in ((n_a <= n_b, (a, n_a), (b, n_b), False), (n_a > n_b, (b, n_b), (a, n_a), True)):
        text = np.repeat(np.arange(len(nx)), nx)
        at = np.flatnonzero(first[text])
        text = text[at]
        to = found_at(x[at], starts(ny)[text], y, (starts(ny) + ny)[text])
        same = y[to] == x[at]
        pair = (at[same], to[same])
        found.append((text[same], *(pair[::-1] if swap else pair)))
    text, at, to = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.argsort(at, kind="stable")
    return text[order], at[order], to[order]


def packed(n: np.ndarray, ids: np.ndarray, last: np.ndarray) -> pa.Array:
    """The tokens of each text (n of them) in 32 bits each, those at ``last`` with the mark of an end."""
    ids = ids.astype(np.uint32)
    ids[last] |= np.uint32(END)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(n)]).astype(np.int64) * 4), pa.py_buffer(ids)]).cast(pa.binary())


def unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The ids of packed tokens, how many each text has, the size of each group, and how many groups each text has."""
    column = column.cast(pa.large_binary())
    _, at, data = column.buffers()
    at = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]].copy().view("<u4") if at[-1] > at[0] else np.zeros(0, np.uint32)
    at = (at - at[0]) // 4
    last = np.flatnonzero(raw & END)
    return (raw & (END - 1)).astype(np.int64), np.diff(at), np.diff(last, prepend=-1), np.diff(np.searchsorted(last, at))


def aligned(docs: DataFrame, a_path: str, a_pattern: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, a, b: the packed tokens of both sides with the ends of their groups, as ``unpacked`` gives them; no tokens where the bytes differ."""

    def start():
        one, two = ByteTokenizer(a_path, a_pattern), PieceTokenizer(b_path)

        def work(ids, texts):
            plain, texts = plain_texts(texts), texts.to_pylist()
            a, b = [one.encode(" " + t, p) if t else [] for t, p in zip(texts, plain.tolist(), strict=True)], two.model.encode(texts, num_threads=1)
            for k, text in enumerate(texts):  # A always spells the text
                if not two.spells(b[k], b" " + text.encode()):
                    a[k] = b[k] = []
            n_a, n_b = (np.fromiter(map(len, side), np.int64, len(side)) for side in (a, b))
            a, b = (np.fromiter(chain.from_iterable(side), np.int32, int(n.sum())) for side, n in ((a, n_a), (b, n_b)))
            # ends within all texts of the slice (at most 2^31 bytes), so that they keep their order
            _, at, to = common_ends(np.cumsum(one.size[a]), n_a, np.cumsum(two.size[b]), n_b)
            return {"id": ids, "a": packed(n_a, a, at), "b": packed(n_b, b, to)}

        return work

    return map_texts(docs, id_col, text_col, start, "id long, a binary, b binary").withColumnRenamed("id", id_col)


def groups_of(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, group (from 0), a_ids, b_ids: one row for each group of aligned rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch):
                (a, _, m, groups), (b, _, n, _) = unpacked(part.column("a")), unpacked(part.column("b"))
                lists = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(k)]).astype(np.int32)), pa.array(x.astype(np.int32))) for k, x in ((m, a), (n, b))]
                row = np.repeat(np.arange(part.num_rows), groups)
                yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(row)), pa.array(within(groups)), *lists], ["id", "group", "a_ids", "b_ids"])

    found = rows.select(F.col(id_col).cast("long").alias("id"), "a", "b").mapInArrow(run, "id long, group long, a_ids array<int>, b_ids array<int>")
    return found.withColumnRenamed("id", id_col)


def within(n: np.ndarray) -> np.ndarray:
    """0, 1, ..., n - 1 for each of the numbers, one after another."""
    return np.arange(n.sum()) - np.repeat(starts(n), n)


def links(a: np.ndarray, b: np.ndarray, m: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group, pair (a << 32 | b) and times of the links of groups that hold m tokens of a and n of b each."""
    wide = np.flatnonzero(m * n > WIDE)
    some = np.where(m * n > WIDE, 0, m * n)
    group = np.repeat(np.arange(len(m)), some)
    k, across = within(some), n[group]
    pair = a[starts(m)[group] + k // across] << 32 | b[starts(n)[group] + k % across]
    out = [(group, pair, np.ones(len(group), np.int64))]
    at, to = starts(m), starts(n)
    for g in wide.tolist():
        x, cx = np.unique(a[at[g] : at[g] + m[g]], return_counts=True)
        y, cy = np.unique(b[to[g] : to[g] + n[g]], return_counts=True)
        out.append((np.full(len(x) * len(y), g), (x[:, None] << 32 | y[None]).ravel(), (cx[:, None] * cy[None]).ravel()))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def linked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, number of the pair and times of all links of aligned rows, and the pairs by number."""
    (a, _, m, groups), (b, _, n, _) = unpacked(batch.column("a")), unpacked(batch.column("b"))
    group, pair, times = links(a, b, m, n)
    number, pairs = pd.factorize(pair)
    return np.repeat(np.arange(batch.num_rows), groups)[group], number, times, pairs


def parts(batch: pa.RecordBatch, most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Consecutive rows with a bounded number of bytes of A's tokens (a longer text is alone)."""
    end, first = np.cumsum(pc.binary_length(batch.column("a")).to_numpy().astype(np.int64)), 0
    while first < batch.num_rows:
        before = end[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(end, before + most, "right")))
        yield batch.slice(first, last - first)
        first = last


def pair_counts(rows: DataFrame) -> DataFrame:
    """pair, n (rows that link it), best (whether its A token has no pair with more)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch):
                row, number, _, pairs = linked(part)
                each = pd.unique(number * part.num_rows + row) // part.num_rows  # a pair once for each row that links it
                yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(np.bincount(each, minlength=len(pairs)))], ["pair", "n"])

    small_batches(rows.sparkSession)
    counts = rows.select("a", "b").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = stored(counts, "pairs")
    token = F.shiftright("pair", 32).alias("token")
    most = counts.groupBy(token).agg(F.max("n").alias("most"))  # a row for each id of A
    return counts.withColumn("token", token).join(most, "token").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def frequent(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``most`` most frequent pairs, sorted, their counts and whether they are best."""
    got = counts.orderBy(F.desc("n"), "pair").limit(most).toArrow()
    pair, n, best = (got.column(c).to_numpy() for c in ("pair", "n", "best"))
    order = np.argsort(pair)
    return pair[order], n[order], best[order]


def decimals(n: int) -> np.ndarray:
    """The digits of 0 to n - 1, right-aligned before a free column, 0 where there is none."""
    width = len(str(max(1, n - 1)))
    k = np.arange(n)
    cells = np.zeros((n, width + 1), np.uint8)
    for j in range(width):
        cells[:, width - 1 - j] = np.where((k >= 10**j) | (j == 0), k // 10**j % 10 + 48, 0)
    return cells


def digests(part: pa.RecordBatch, shown: np.ndarray, width: np.ndarray) -> list[str]:
    """The SHA-256 of each row's groups as ``a1,a2|b1;a3|b2,b3``, ids in decimal; "" without tokens."""
    (a, _, m, groups), (b, _, n, _) = unpacked(part.column("a")), unpacked(part.column("b"))
    both, ids = starts(m + n), np.zeros(len(a) + len(b), np.int64)
    ids[np.repeat(both, m) + within(m)] = a
    ids[np.repeat(both + m, n) + within(n)] = b
    cells = shown[ids]
    cells[:, -1] = ord(",")
    cells[both + m - 1, -1] = ord("|")
    cells[both + m + n - 1, -1] = ord(";")
    end = np.concatenate([[0], np.cumsum(width[ids])])
    text, end = cells[cells > 0], end[np.concatenate([[0], np.cumsum(m + n)])][np.concatenate([[0], np.cumsum(groups)])]
    return [hashlib.sha256(text[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(end[:-1].tolist(), end[1:].tolist(), strict=True)]


REPORT = "id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, row long, rest array<struct<pair:long,times:long>>"


def weighed(rows: DataFrame, counts: DataFrame, id_col: str = "doc_id", most: int = MOST_PAIRS) -> DataFrame:
    """One row for each aligned row (id, row, a, b; ``row`` tells them apart): id, n_a, n_b, n_groups, n_links, n_best (links whose pair is best), count_sum (counts of the pairs, over all links), groups_sha256."""
    spark = rows.sparkSession
    small_batches(spark)
    counts = stored(counts, "counts")
    table = spark.sparkContext.broadcast(frequent(counts, most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (known, n, best), shown, width = table.value, np.zeros((0, 1), np.uint8), np.zeros(0, np.int64)
        for batch in batches:
            for part in parts(batch):
                row, number, times, pairs = linked(part)
                at = np.searchsorted(known, pairs)
                there = np.zeros(len(pairs), bool)
                there[at < len(known)] = known[at[at < len(known)]] == pairs[at < len(known)]
                count, top = np.zeros((2, len(pairs)), np.int64)
                count[there], top[there] = n[at[there]], best[at[there]]

                def total(x: np.ndarray, row: np.ndarray = row, rows: int = part.num_rows) -> np.ndarray:
                    out = np.zeros(rows, np.int64)
                    np.add.at(out, row, x)
                    return out

                rest = np.flatnonzero(~there[number])
                rest = rest[np.argsort(row[rest], kind="stable")]
                bound = np.concatenate([[0], np.cumsum(np.bincount(row[rest], minlength=part.num_rows))]).astype(np.int32)
                rest = pa.ListArray.from_arrays(pa.array(bound), pa.StructArray.from_arrays([pa.array(pairs[number[rest]]), pa.array(times[rest])], ["pair", "times"]))
                (a, n_a, _, groups), (b, n_b, _, _) = unpacked(part.column("a")), unpacked(part.column("b"))
                most_id = max(a.max(initial=0), b.max(initial=0))
                if most_id >= len(shown):
                    shown = decimals(int(most_id) + 1)
                    width = (shown > 0).sum(axis=1) + 1
                cols = [part.column("id"), *map(pa.array, (n_a, n_b, groups, total(times), total(top[number] * times), total(count[number] * times))), pa.array(digests(part, shown, width), pa.string()), part.column("row"), rest]
                yield pa.RecordBatch.from_arrays(cols, [f.split()[0] for f in REPORT.split(", ")])

    found = rows.select(F.col(id_col).cast("long").alias("id"), "row", "a", "b").mapInArrow(run, REPORT)
    if counts.count() > most:
        found = stored(found, "weighed")
        rest = found.select("row", F.explode("rest").alias("of")).select("row", "of.pair", "of.times").join(counts, "pair")
        rest = rest.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("n") * F.col("times")).alias("more"))
        found = found.join(rest, "row", "left").withColumns({"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more", F.lit(0))})
    return found.select(F.col("id").alias(id_col), *(f.split()[0] for f in REPORT.split(", ")[1:8]))


def alignment_report(docs: DataFrame, a_path: str, a_pattern: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", most: int = MOST_PAIRS) -> DataFrame:
    """Aligns all texts, counts all pairs, and weighs the links of each text by the counts."""
    rows = aligned(docs, a_path, a_pattern, b_path, id_col, text_col).withColumn("row", F.monotonically_increasing_id())
    rows = stored(rows, "aligned", **{"parquet.block.size": ROW_GROUP, "compression": "zstd"})
    return weighed(rows, pair_counts(rows), id_col, most)
