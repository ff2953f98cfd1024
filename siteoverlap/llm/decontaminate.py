"""Benchmark passages in documents: q-gram lemma, diagonal bands, banded alignment.

A passage of m characters with at most e edits keeps at least m + 1 - q(e + 1) of
its q-grams, all of them near one diagonal (place in the document minus place in
the passage). Shared q-grams are counted in diagonal bands of width 2(e + 1) that
overlap by half, so every such passage lies in one band; bands that reach the
bound are verified by a banded edit-distance alignment.

Places of an item that hold one q-gram again and again are counted once for each
stretch as wide as half a band, for all diagonals that the stretch may stand for, so
a repetitive text costs no more than a few counts a byte and item and the bound
still holds.

An item of m bytes may have 8 % edits, but at most (m - q) / q: with more, the lemma
would not ask for a single q-gram. (So items of 13 to 19, 25 to 29 and 38 or 39 bytes
have one edit less than 8 %.) Texts are compared as bytes with A-Z in lower case and
white space as blanks. Items shorter than ``q + 1`` bytes are no evidence and match
nothing. Null or empty texts have no matches; repeated rows give repeated matches;
an empty table gives an empty one. A very long text is one slice, read window by
window. Of equally good ends of a match the first counts. Columns other than the
named ones are never read, so they may have any name.

The items are handled in blocks of bounded size, each against all documents; the
result of each of several blocks is stored, so the driver holds one block at a time.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textio import buffers, map_texts, stored, text_column

Q = 10
#: Edits for each byte of an item that a match may have.
ERRORS = 0.08
BLOCK_BYTES = 1 << 21
#: Bytes whose q-grams are looked up at once, and shared q-grams that are counted at once.
WINDOW, HITS = 1 << 18, 1 << 21
#: Bits of the first, inexact look-up.
FILTER_BITS = 22

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[9:14] = 32
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def folded(text: bytes) -> np.ndarray:
    return _FOLD[np.frombuffer(text, np.uint8)]


def grams(data: np.ndarray) -> np.ndarray:
    """Hash of the Q = 10 bytes from each place on."""
    if len(data) < Q:
        return np.zeros(0, np.uint64)
    one = data.astype(np.uint64)
    two = one[:-1] | one[1:] << np.uint64(8)
    four = two[:-2] | two[2:] << np.uint64(16)
    eight = four[:-4] | four[4:] << np.uint64(32)
    h = eight[:-2] * _A ^ two[8:] * _B
    h ^= h >> np.uint64(29)
    return h * _A


class Index:
    """Q-grams of a block of items."""

    def __init__(self, items: list[tuple[int, bytes]], errors: float = ERRORS):
        self.ids = [i for i, _ in items]
        self.texts = [folded(t) for _, t in items]
        size = np.array([len(t) for t in self.texts], np.int64)
        self.edits = np.minimum((size * errors).astype(np.int64), (size - Q) // Q)
        self.least = size + 1 - Q * (self.edits + 1)
        hashes = [grams(t) for t in self.texts]
        every = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(items)), [len(h) for h in hashes])
        place = np.concatenate([np.arange(len(h)) for h in hashes]) if hashes else np.zeros(0, np.int64)
        # places of a q-gram in the same stretch of an item become one posting
        stretch = place // (self.edits + 1)[item] if len(items) else place
        order = np.lexsort((place, stretch, item, every))
        every, item, place, stretch = every[order], item[order], place[order], stretch[order]
        new = np.ones(len(every), bool)
        new[1:] = (every[1:] != every[:-1]) | (item[1:] != item[:-1]) | (stretch[1:] != stretch[:-1])
        self.item, self.low = item[new].astype(np.int32), place[new].astype(np.int32)
        self.high = place[np.append(np.flatnonzero(new)[1:], len(every)) - 1].astype(np.int32) if len(every) else self.low
        self.keys, self.first, self.n = np.unique(every[new], return_index=True, return_counts=True)
        self.maybe = np.zeros(1 << FILTER_BITS, bool)
        self.maybe[self.keys >> np.uint64(64 - FILTER_BITS)] = True

    def hits(self, data: np.ndarray):
        """(place in data, posting) of all shared q-grams, at most about ``HITS`` at once."""
        for a in range(0, max(0, len(data) - Q + 1), WINDOW):
            h = grams(data[a : a + WINDOW + Q - 1])
            at = np.flatnonzero(self.maybe[h >> np.uint64(64 - FILTER_BITS)])
            k = np.searchsorted(self.keys, h[at])
            k[k == len(self.keys)] = 0
            same = self.keys[k] == h[at]
            at, k = at[same], k[same]
            n = self.n[k]
            reach = np.cumsum(n)
            b = 0
            while b < len(at):
                c = max(b + 1, int(np.searchsorted(reach, (reach[b - 1] if b else 0) + HITS, "right")))
                m = n[b:c]
                post = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(self.first[k[b:c]], m)
                yield np.repeat(at[b:c] + a, m), post
                b = c

    def bands(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows (text, item, band) in order and how many q-grams each band has; a band is two steps wide and overlaps the next by one."""
        items, low = len(self.texts), -int(self.high.max(initial=0)) - 2
        width = len(data) - low + 1  # more than there are bands of a text and item
        keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for at, post in self.hits(data):
            text = np.searchsorted(off, at, "right") - 1
            fits = at + Q <= off[text + 1]
            at, post, text = at[fits] - off[text[fits]], post[fits], text[fits]
            item = self.item[post].astype(np.int64)
            step = self.edits[item] + 1
            upper, lower = (at - self.low[post]) // step, (at - self.high[post]) // step
            two = upper > lower  # a stretch may lie on two steps
            first = (text * items + item) * width - low
            key, n = np.unique(np.concatenate([first + upper, first + lower - 1, (first + lower)[two]]), return_counts=True)
            keys.append(key)
            counts.append(n)
        every = np.concatenate(keys)
        order = np.argsort(every, kind="stable")
        every, n = every[order], np.concatenate(counts)[order]
        start = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.zeros(0, np.int64)
        pair, band = np.divmod(every[start], width)
        return np.stack([pair // max(1, items), pair % max(1, items), band + low], axis=1), np.add.reduceat(n, start) if len(start) else n

    def regions(self, data: np.ndarray, off: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(text, item, first diagonal, last diagonal) of runs of bands that reach the bound."""
        if not len(self.keys):
            return []
        keys, count = self.bands(data, off)
        text, item, band = keys.T
        enough = count >= self.least[item]
        out: list[tuple[int, int, int, int]] = []
        for t, i, b in zip(text[enough].tolist(), item[enough].tolist(), band[enough].tolist(), strict=True):
            step = int(self.edits[i]) + 1
            if out and out[-1][:2] == (t, i) and b * step <= out[-1][3] + 1:
                out[-1] = (t, i, out[-1][2], (b + 2) * step - 1)
            else:
                out.append((t, i, b * step, (b + 2) * step - 1))
        return out


def align(item: np.ndarray, text: np.ndarray, low: int, high: int, anchored: bool = False) -> tuple[int, int]:
    """Least edits between the item and a part of the text, over paths on diagonals low..high, and where that part ends.

    The part may begin anywhere on these diagonals, or only at 0 if ``anchored``.
    """
    width, diagonal = high - low + 1, np.arange(high - low + 1)
    far = 1 << 30
    place = low + diagonal
    cost = np.where((place >= 0) & (place <= len(text)), 0, far)
    if anchored:
        cost = np.where(cost == 0, place, far)
    padded = np.concatenate([np.full(max(0, -low), 256, np.int32), text.astype(np.int32), np.full(max(0, high + len(item) - len(text)) + 1, 256, np.int32)])
    shift = max(0, low)
    for k, c in enumerate(item):
        row = cost + (padded[shift + k : shift + k + width] != c)
        row[:-1] = np.minimum(row[:-1], cost[1:] + 1)
        row = np.minimum.accumulate(row - diagonal) + diagonal
        ends = k + 1 + place
        cost = np.where((ends >= 0) & (ends <= len(text)), row, far)
    best = int(cost.argmin())
    return int(cost[best]), len(item) + low + best


def matches(index: Index, data: np.ndarray, off: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(text, item, first byte, end byte, edits) of all verified regions."""
    out = []
    for t, i, low, high in index.regions(data, off):
        text, item, e = data[off[t] : off[t + 1]], index.texts[i], int(index.edits[i])
        a = max(0, low - e)
        part = text[a : high + e + len(item) + e]
        edits, end = align(item, part, low - e - a, high + e - a)
        if edits <= e:
            back = part[max(0, end - len(item) - e) : end][::-1]
            _, size = align(item[::-1], back, -e, e, anchored=True)
            out.append((t, i, a + end - size, a + end, edits))
    return out


def items_of(benchmark: DataFrame, item_col: str, text_col: str, blocks: int = 1, k: int = 0) -> list[tuple[int, bytes]]:
    """The items of one of so many blocks, in order; those too short to be evidence are left out."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.encode(F.col(text_col).cast("string"), "utf-8").alias("bytes")).where(F.length("bytes") > Q)
    block = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item", "bytes"), F.lit(blocks)) == k)
    return sorted(((r["item"], bytes(r["bytes"])) for r in block.collect()), key=lambda x: (x[0] is None, x))


def blocks_of(benchmark: DataFrame, item_col: str, text_col: str) -> int:
    """How many blocks of about ``BLOCK_BYTES`` the items need."""
    total = benchmark.agg(F.coalesce(F.sum(F.octet_length(F.col(text_col).cast("string"))), F.lit(0))).first()[0]
    return max(1, -(-total // BLOCK_BYTES))


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", errors: float = ERRORS) -> DataFrame:
    """One row a match: document id, item_id, start and end (code points, end exclusive), edits."""
    out, blocks = None, blocks_of(benchmark, item_col, item_text_col)
    for k in range(blocks):
        got = items_of(benchmark, item_col, item_text_col, blocks, k)

        def start(got=got):
            index = Index(got, errors)

            def work(ids, texts):
                data, off = buffers(texts)
                rows = {"id": [], "item_id": [], "start": [], "end": [], "edits": []}
                ids = ids.to_pylist()
                for t, i, a, b, edits in matches(index, _FOLD[data], off):
                    raw = data[off[t] : off[t + 1]].tobytes()
                    first = len(raw[:a].decode("utf-8", "ignore"))
                    for name, v in zip(rows, (ids[t], index.ids[i], first, first + len(raw[a:b].decode("utf-8", "ignore")), edits), strict=True):
                        rows[name].append(v)
                return rows

            return work

        part = map_texts(docs, id_col, text_col, start, "id long, item_id long, start int, end int, edits int")
        part = stored(part, "leaks") if blocks > 1 else part
        out = part if out is None else out.unionByName(part)
    return out.withColumnRenamed("id", id_col)


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", errors: float = ERRORS) -> DataFrame:
    """The documents without any benchmark passage. Each row is judged by its own text, whatever its id."""
    blocks = blocks_of(benchmark, item_col, item_text_col)
    for k in range(blocks):
        got = items_of(benchmark, item_col, item_text_col, blocks, k)

        def start(got=got):
            index = Index(got, errors)

            def work(texts):
                data, off = buffers(texts)
                bad = np.zeros(len(texts), bool)
                bad[[m[0] for m in matches(index, _FOLD[data], off)]] = True
                return bad

            return work

        docs = docs.where(~text_column(docs, text_col, start, "boolean"))
        docs = stored(docs, "clean") if k + 1 < blocks else docs
    return docs
