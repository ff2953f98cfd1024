"""Near-duplicate classes: Jaccard join on word shingles with signature trees.

1. One pass turns each text into the set of hashes of its distinct k-word
   shingles and keeps a compact signature: set size, a fingerprint of the set,
   a bitmap of its tokens, and the prefix of the set that any partner at the
   threshold must share a token with. Texts with equal sets are one vertex from
   here on. Tokens that a sample finds in many texts come last in the order of
   the prefixes; any order gives the same links.
2. Prefix tokens only deal the vertices to blocks: a token's centre is the smallest
   vertex that has it, and all vertices that share a token with a centre at its own
   tokens form the centre's block. Linked vertices always share a block.
3. Signature trees find the candidates. Nodes hold the OR of their bitmaps and the
   range of sizes; a dual traversal drops pairs of nodes whose largest possible
   overlap is too small, or whose vertices are all linked already. A block yields all
   its candidates if they are few; of many, each vertex first gets two, its likeliest
   partner and the hub, the partner with the most candidates. A block of more than
   ``PART`` vertices is dealt to several trees by a hash.
4. Candidates are verified on the whole sets; components follow by the alternating
   star algorithm. Blocks not searched in full go on with one representative of each
   component, as long as that finds links. Last, trees are held against each other:
   all pairs of parts of a block but those of one component or without a common range
   of sizes. So the pairs left out are those of one component, and no link between
   different texts is lost.

Texts are compared by 64-bit hashes. Null, empty and blank texts have no shingles
and no links. Repeated rows keep their rows and share a component; ties (equal
similarity, equal ids) have no influence on components. A very long text costs
memory in proportion to its length (a few dozen bytes a word). An empty table gives
an empty one. Rows without an id get the component's smallest id. Only the id and
text columns are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .textio import BROADCAST_ROWS, bounded, buffers, freed, map_texts, stored, text_column

#: About so many texts are counted to find tokens that many texts have; in how many of them such a token is, and how many are noted at most.
SAMPLE_TEXTS, SAMPLE_LEAST, MOST_FREQUENT = 10_000, 3, 200_000
#: Vertices of a tree; larger blocks are dealt to several trees.
PART = 2048
#: A tree's candidates count as few up to so many for each of its vertices.
FEW_PAIRS = 4
#: Vertices of a tree's lowest nodes, children of the others.
BUCKET, FANOUT = 32, 8

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_MUL = np.uint64(0x9E3779B97F4A7C15)
_LONG = 1 << 16


def _tables() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(2024)
    value = rng.integers(1, 1 << 63, 256, dtype=np.uint64)
    value[_SPACE] = 0
    power = np.cumprod(np.full(_LONG, 0xD1342543DE82EF95, np.uint64), dtype=np.uint64)
    return value, power


_VALUE, _POWER = _tables()


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MUL
    return h ^ (h >> np.uint64(29))


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of all texts, and the number of its text."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    data = _FOLD[data]
    is_word = ~_SPACE[data]
    first = is_word.copy()
    first[1:] &= ~is_word[:-1]
    edge = off[:-1][off[:-1] < len(data)]
    first[edge] = is_word[edge]
    start = np.flatnonzero(first)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    span = np.diff(np.append(start, len(data)))
    at = np.arange(start[0], len(data), dtype=np.uint32)  # 4 GB at most; numpy in place, so that a slice costs few times its size
    at -= np.repeat(start.astype(np.uint32), span)
    at &= np.uint32(_LONG - 1)
    value = _VALUE[data[start[0] :]]
    value *= _POWER[at]
    del at
    size = np.add.reduceat(is_word.astype(np.uint64), start)
    return mixed(np.add.reduceat(value, start - start[0]) + size * _MUL), np.searchsorted(off, start, "right") - 1


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    data, off = buffers(texts)
    words, text = word_hashes(data, off)
    n = len(off) - 1
    count = np.bincount(text, minlength=n)
    first = np.cumsum(count) - count

    def chain(parts):
        h = np.full(len(parts[0]), len(parts), np.uint64)
        for p in parts:
            h = mixed(h * _MUL + p)
        return h

    sets = [np.zeros(0, np.uint64)] * n
    if len(words) >= k:
        every = chain([words[j : len(words) - k + 1 + j] for j in range(k)])
    for t in np.flatnonzero(count):
        a, c = first[t], count[t]
        sets[t] = np.unique(every[a : a + c - k + 1]) if c >= k else chain([words[a + j : a + j + 1] for j in range(c)])
    return sets


def fingerprint(tokens: np.ndarray) -> int:
    return int.from_bytes(hashlib.md5(tokens.tobytes()).digest()[:8], "little", signed=True)


def bitmap(tokens: np.ndarray) -> bytes:
    """Four bits or more for each token; a power of two of them, so that a longer map folds to a shorter one."""
    width = max(64, 1 << (4 * len(tokens) - 1).bit_length())
    bits = np.zeros(width, bool)
    bits[(tokens >> np.uint64(20)) & np.uint64(width - 1)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def folded(bits: int, width: int, to: int) -> int:
    while width > to:
        width //= 2
        bits = (bits & ((1 << width) - 1)) | (bits >> width)
    return bits


def prefix(tokens: np.ndarray, frequent: np.ndarray, percent: int) -> np.ndarray:
    """The tokens of which a partner must have one: rare ones first, then by hash."""
    n = len(tokens)
    size = n - -(-n * percent // 100) + 1
    if len(frequent):
        k = np.searchsorted(frequent, tokens)
        often = frequent[np.minimum(k, len(frequent) - 1)] == tokens
        if often.any():
            tokens = np.concatenate([tokens[~often], tokens[often]])
    return tokens[:size]


def lists(arrays: list[np.ndarray]) -> pa.Array:
    at = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([*arrays, np.zeros(0, np.uint64)]).view(np.int64)))


def frequent_tokens(docs: DataFrame, id_col: str, text_col: str, k: int) -> np.ndarray:
    """Tokens of many sampled texts, sorted; a bounded number."""
    every = max(1, docs.count() // SAMPLE_TEXTS)
    sample = docs.where(F.pmod(F.xxhash64(F.col(id_col).cast("long"), F.lit(1)), F.lit(every)) == 0)

    def start():
        return lambda ids, texts: {"tokens": lists(shingle_sets(texts, k))}

    tokens = map_texts(sample, id_col, text_col, start, "tokens array<long>").select(F.explode("tokens").alias("token"))
    often = tokens.groupBy("token").count().where(F.col("count") >= SAMPLE_LEAST)
    got = [r[0] for r in often.orderBy(F.desc("count"), "token").limit(MOST_FREQUENT).collect()]
    return np.sort(np.array(got, np.int64).view(np.uint64))


def signatures(docs: DataFrame, id_col: str, text_col: str, k: int, percent: int, frequent: np.ndarray) -> DataFrame:
    """id, mark (hash of the text), n, vertex (null without shingles), prefix, bits."""

    def start():
        def work(texts):
            sets = shingle_sets(texts, k)
            return pa.StructArray.from_arrays(
                [
                    pa.array([len(s) for s in sets], pa.int32()), pa.array([fingerprint(s) if len(s) else None for s in sets], pa.int64()),
                    lists([prefix(s, frequent, percent) if len(s) else s for s in sets]), pa.array([bitmap(s) if len(s) else None for s in sets], pa.binary()),
                ],
                names=["n", "vertex", "prefix", "bits"],
            )

        return work

    made = text_column(docs, text_col, start, "struct<n:int,vertex:long,prefix:array<long>,bits:binary>")
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("mark"), made.alias("made")).select("id", "mark", "made.*")


def overlap_needed(a: int, b: int, percent: int) -> int:
    """Least intersection of sets of these sizes at the threshold."""
    return -(-percent * (a + b) // (100 + percent))


def may_link(na: int, a: bytes, nb: int, b: bytes, percent: int) -> bool:
    """Upper bound from two bitmaps: common bits, and the tokens that share a bit with another."""
    if 100 * min(na, nb) < percent * max(na, nb):
        return False
    width = 8 * min(len(a), len(b))
    x, y = folded(int.from_bytes(a, "little"), 8 * len(a), width), folded(int.from_bytes(b, "little"), 8 * len(b), width)
    return (x & y).bit_count() + min(na - x.bit_count(), nb - y.bit_count()) >= overlap_needed(na, nb, percent)


class Node:
    """A bucket of vertices, or up to FANOUT nodes: OR of the bitmaps, range of sizes, most tokens that share a bit with another, common component if any."""

    __slots__ = ("bits", "children", "component", "doubled", "high", "low", "rows")

    def __init__(self, children: list[Node], rows: slice | None, maps: np.ndarray, n: np.ndarray, doubled: np.ndarray, component: np.ndarray):
        self.children, self.rows = children, rows
        if rows is not None:
            self.bits = np.bitwise_or.reduce(maps[rows], axis=0)
            self.low, self.high, self.doubled = int(n[rows].min()), int(n[rows].max()), int(doubled[rows].max())
            same = component[rows]
            self.component = int(same[0]) if (same == same[0]).all() else None
        else:
            self.bits = np.bitwise_or.reduce([c.bits for c in children], axis=0)
            self.low, self.high, self.doubled = min(c.low for c in children), max(c.high for c in children), max(c.doubled for c in children)
            self.component = children[0].component if len({c.component for c in children}) == 1 else None


def tree(first: int, last: int, *of: np.ndarray) -> Node:
    """A tree over the rows first to last of the arrays."""
    nodes = [Node([], slice(k, min(k + BUCKET, last)), *of) for k in range(first, last, BUCKET)]
    while len(nodes) > 1:
        nodes = [Node(nodes[k : k + FANOUT], None, *of) for k in range(0, len(nodes), FANOUT)]
    return nodes[0]


def tree_pairs(rows: list[tuple], percent: int, few: int | None = None) -> tuple[list[tuple[int, int]], bool]:
    """Pairs of vertices that may link and are in different components, and whether these are all.

    rows: (vertex, n, bits, component, part); only pairs of different parts, or
    any pairs where all rows are of one part. More than ``few`` pairs for each row
    are not all given: each vertex gets its likeliest partner and its hub.
    """
    pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    parts = {r[4] for r in rows}
    many = Counter(r[3] for r in rows)
    for length in sorted({len(r[2]) for r in rows}):
        most = max(r[1] for r in rows if len(r[2]) == length) * 100 // percent
        some = [r for r in rows if len(r[2]) == length or (len(r[2]) > length and r[1] <= most)]
        # vertices of a large component side by side, all others by size
        some.sort(key=lambda r: (r[4], r[3] if many[r[3]] >= BUCKET // 4 else -(1 << 63), r[1], r[0]))
        maps = np.stack([np.bitwise_or.reduce(np.frombuffer(r[2], np.uint64).reshape(-1, length // 8), axis=0) for r in some])
        vertex, n, component, part = (np.array([r[k] for r in some], np.int64) for k in (0, 1, 3, 4))
        own = np.array([len(r[2]) == length for r in some])
        doubled = n - np.bitwise_count(maps).sum(axis=1, dtype=np.int64)
        edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
        roots = [tree(a, b, maps, n, doubled, component) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        todo = [(roots[0], roots[0])] if len(parts) == 1 else [(x, y) for k, x in enumerate(roots) for y in roots[:k]]
        while todo:
            x, y = todo.pop()
            if x.component is not None and x.component == y.component:
                continue
            if 100 * x.high < percent * y.low or 100 * y.high < percent * x.low:
                continue
            if int(np.bitwise_count(x.bits & y.bits).sum(dtype=np.int64)) + min(x.doubled, y.doubled) < overlap_needed(x.low, y.low, percent):
                continue
            if x.rows is not None and y.rows is not None:
                i, j = x.rows, y.rows
                common = np.bitwise_count(maps[i, None] & maps[None, j]).sum(axis=2, dtype=np.int64)
                spare = common + np.minimum(doubled[i, None], doubled[None, j]) + (-percent * (n[i, None] + n[None, j])) // (100 + percent)
                ok = (spare >= 0) & (component[i, None] != component[None, j]) & (own[i, None] | own[None, j])
                ok &= 100 * np.minimum(n[i, None], n[None, j]) >= percent * np.maximum(n[i, None], n[None, j])
                if x is y:
                    ok = np.triu(ok, 1)
                if ok.any():
                    p, q = np.nonzero(ok)
                    pairs.append((vertex[i][p], vertex[j][q], spare[p, q].astype(np.int32)))
            elif x is y:
                todo += [(x.children[i], x.children[j]) for i in range(len(x.children)) for j in range(i, len(x.children))]
            elif y.rows is not None or (x.rows is None and x.high - x.low >= y.high - y.low):
                todo += [(c, y) for c in x.children]
            else:
                todo += [(x, c) for c in y.children]
    if not pairs:
        return [], True
    a, b, spare = (np.concatenate([p[k] for p in pairs]) for k in range(3))
    whole = few is None or len(a) <= few * len(rows)
    if not whole:
        a, b = chosen(a, b, spare)
    return sorted(set(zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist(), strict=True))), whole


def chosen(a: np.ndarray, b: np.ndarray, spare: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of many pairs two for each vertex: its likeliest partner, and the partner that has the most pairs."""
    v, w, s = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([spare, spare])
    names, place, degree = np.unique(v, return_inverse=True, return_counts=True)
    busy = degree[np.searchsorted(names, w)]
    out = []
    for weight in (s, busy):
        order = np.lexsort((w, -weight, place))
        first = order[np.flatnonzero(np.concatenate([[True], place[order][1:] != place[order][:-1]]))]
        out.append((v[first], w[first]))
    return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])


def verified(pairs: DataFrame, vertices: DataFrame, docs: DataFrame, id_col: str, text_col: str, k: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) of vertices that link, by their whole sets.

    The sets are made again from the text of one row for each vertex needed.
    """
    need = pairs.select(F.col("a").alias("vertex")).union(pairs.select(F.col("b"))).distinct()
    need = bounded(need.join(vertices, "vertex").select(F.col("vertex").alias("want"), "one"), "need")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("mark"), F.col(text_col).alias("text"))
    texts = texts.join(need, (F.col("mark") == F.col("one.mark")) & F.col("id").eqNullSafe(F.col("one.id")), "left_semi")

    def start():
        def work(_, texts):
            sets = shingle_sets(texts, k)
            return {"vertex": [fingerprint(s) if len(s) else None for s in sets], "tokens": [s.tobytes() for s in sets]}

        return work

    sets = map_texts(texts, "id", "text", start, "vertex long, tokens binary").where("vertex is not null")
    sets = stored(sets.dropDuplicates(["vertex"]), "sets")
    both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b").select("a", "b", "x", "y")

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                same = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * same >= percent * (len(x) + len(y) - same))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))
        freed()

    return both.mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """vertex, component (its smallest vertex) of all vertices of the links (a, b); alternating large and small stars."""
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before, n = None, edges.count()
    while True:
        few = (lambda t: F.broadcast(t)) if n <= BROADCAST_ROWS // 2 else (lambda t: t)  # at most 2 n rows of two numbers
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.where("v > u").join(few(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(least.where("m < u").select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(few(low), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", "m")).distinct()
        edges = stored(small, "edges")
        now = tuple(edges.agg(F.count("*"), F.sum(F.col("v").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == before:
            return edges.select(F.col("u").alias("vertex"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())
        before, n = now, now[0]


#: What the trees get of each vertex.
FIELDS = ("vertex", "n", "bits", "component", "part")


def searched(groups: DataFrame, percent: int, few: int | None) -> DataFrame:
    """a, b, open: candidates of each group (centre, members), and the centres of groups that have more of them."""

    def search(batches):
        for batch in batches:
            found: set[tuple[int, int]] = set()
            more = []
            at, members = batch.column(1).offsets.to_numpy(), batch.column(1).values
            flat = list(zip(*(members.field(f).to_pylist() for f in FIELDS), strict=True))
            for centre, a, b in zip(batch.column(0).to_pylist(), at[:-1], at[1:], strict=True):
                pairs, whole = tree_pairs(flat[a:b], percent, few)
                found.update(pairs)
                more += [] if whole else [centre]
            pairs = np.array(sorted(found), np.int64).reshape(-1, 2)
            none = pa.nulls(len(more), pa.int64())
            cols = [pa.concat_arrays([pa.array(pairs[:, k]), none]) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*cols, pa.concat_arrays([pa.nulls(len(pairs), pa.int64()), pa.array(more, pa.int64())])], ["a", "b", "open"])
        freed()

    return groups.select("centre", "members").mapInArrow(search, "a long, b long, open long")


def grouped(rows: DataFrame, vertices: DataFrame, *more: str) -> DataFrame:
    """centre, members: the rows (centre, vertex, component, part) of each centre and columns ``more`` with what trees need."""
    rows = rows.join(vertices.select("vertex", "n", "bits"), "vertex")
    return rows.groupBy("centre", *more).agg(F.collect_list(F.struct(*FIELDS)).alias("members")).where(F.size("members") > 1)


def dealt(rows: DataFrame, vertices: DataFrame, turn: int) -> DataFrame:
    """Groups of about ``PART`` vertices of a block, by a hash that differs from turn to turn. rows: centre, vertex, component."""
    size = rows.groupBy("centre").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    large = bounded(size.where("parts > 1"), "large")
    tree_of = F.coalesce(F.pmod(F.xxhash64("vertex", F.lit(turn)), F.col("parts")), F.lit(0)).cast("int")
    rows = rows.join(large, "centre", "left").select("centre", "vertex", "component", tree_of.alias("tree"), F.lit(0).alias("part"))
    return grouped(rows, vertices, "tree")


def with_partners(blocks: DataFrame, percent: int) -> DataFrame:
    """The rows (centre, vertex, n) but those whose size no other vertex of the block comes near enough to.

    Sizes are put into classes so wide that partners are in the same or in neighbouring
    ones; only numbers are shuffled.
    """
    width = max(math.log(100 / percent), 1e-9) * (1 + 1e-9)
    rows = blocks.withColumn("size", F.floor(F.ln(F.col("n").cast("double")) / width))
    near = rows.groupBy("centre", "size").count().select("centre", F.explode(F.array(F.col("size") - 1, F.col("size"), F.col("size") + 1)).alias("size"), "count")
    near = near.groupBy("centre", "size").agg(F.sum("count").alias("m")).where("m > 1").select("centre", "size")
    return rows.join(near, ["centre", "size"], "left_semi").select("centre", "vertex", "n")


def held_apart(rows: DataFrame, vertices: DataFrame, percent: int) -> DataFrame:
    """Groups of two parts of a block that may hold a link between different components. rows: centre, vertex, component.

    A component of more than ``PART`` vertices has parts of its own, the others share
    parts; nothing is compared within a component.
    """
    rows = rows.join(vertices.select("vertex", "n"), "vertex")
    own = rows.groupBy("centre", "component").agg(F.count("*").alias("m"))
    total = own.groupBy("centre").agg(F.sum(F.when(F.col("m") <= PART, F.col("m"))).alias("rest"), F.count("*").alias("several")).where("several > 1")
    large = bounded(own.where(F.col("m") > PART), "large")
    rows = rows.join(large, ["centre", "component"], "left").join(bounded(total, "total"), "centre")
    pure = F.when(F.col("m").isNotNull(), F.col("component"))
    sub = F.when(F.col("m").isNotNull(), F.pmod(F.xxhash64("vertex"), F.ceil(F.col("m") / PART))).otherwise(F.pmod(F.xxhash64("component"), F.ceil(F.col("rest") / PART)))
    rows = stored(rows.select("centre", "vertex", "component", "n", pure.alias("pure"), F.xxhash64(pure, sub).alias("part")), "dealt")
    parts = stored(rows.groupBy("centre", "part", "pure").agg(F.min("n").alias("low"), F.max("n").alias("high")), "parts")
    a, b = (parts.select("centre", *(F.col(c).alias(f"{c}_{x}") for c in ("part", "pure", "low", "high"))) for x in "ab")
    pairs = a.join(b, "centre").where("part_a <= part_b and not (pure_a <=> pure_b and pure_a is not null)")
    pairs = pairs.where((100 * F.col("high_a") >= percent * F.col("low_b")) & (100 * F.col("high_b") >= percent * F.col("low_a"))).select("centre", "part_a", "part_b")
    sides = pairs.select("centre", "part_a", "part_b", F.explode(F.array_distinct(F.array("part_a", "part_b"))).alias("part"))
    return grouped(rows.select("centre", "vertex", "component", "part").join(sides, ["centre", "part"]), vertices, "part_a", "part_b")


def classes(docs: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The signatures (id, mark, n, vertex, ...), and vertex, keeper of all vertices that several rows or links have; keeper is the struct (id, mark) of the row that is kept."""
    frequent = frequent_tokens(docs, id_col, text_col, k)
    sig = stored(signatures(docs, id_col, text_col, k, percent, frequent), "signatures")
    one = F.struct(F.col("id").isNull().alias("none"), "id", "mark")
    vertices = stored(sig.where("vertex is not null").groupBy("vertex").agg(F.min(one).alias("one"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("bits").alias("bits")), "vertices")

    tokens = sig.where("vertex is not null").select(F.explode("prefix").alias("token"), "vertex", "n")
    shared = tokens.groupBy("token").agg(F.min("vertex").alias("centre"), F.max("vertex").alias("last")).where("centre <> last").select("token", "centre")
    blocks = stored(tokens.join(bounded(shared, "shared"), "token").select("centre", "vertex", "n").distinct(), "blocks")
    blocks = stored(with_partners(blocks, percent).select("centre", "vertex"), "blocks")

    alone = blocks.select("centre", "vertex", F.col("vertex").alias("component"))
    first = stored(searched(dealt(alone, vertices, 0), percent, FEW_PAIRS), "searched")
    links = stored(verified(first.where("a is not null").select("a", "b").distinct(), vertices, docs, id_col, text_col, k, percent), "links")
    parts = components(links)

    open_ = first.where("open is not null").select(F.col("open").alias("centre")).union(blocks.groupBy("centre").count().where(F.col("count") > PART).select("centre")).distinct()
    open_ = bounded(open_, "open")
    if not open_.isEmpty():
        rest = stored(blocks.join(open_, "centre", "left_semi"), "rest")
        turn, found = 1, True
        while True:
            rows = rest.join(parts, "vertex", "left").select("centre", "vertex", F.coalesce("component", "vertex").alias("component"))
            if not found:
                more = searched(held_apart(rows, vertices, percent), percent, None)
            else:
                some = rows.groupBy("centre", "component").agg(F.min_by("vertex", F.xxhash64("vertex", F.lit(turn))).alias("vertex"))
                more = searched(dealt(some, vertices, turn), percent, FEW_PAIRS)
            more = stored(more.where("a is not null").select("a", "b").distinct(), "more")
            new = stored(verified(more, vertices, docs, id_col, text_col, k, percent), "new")
            last, found, turn = not found, not new.isEmpty(), turn + 1
            if found:
                links = links.union(new)
                parts = components(links)
            if last:
                break

    keepers = parts.join(vertices.select("vertex", "one"), "vertex").groupBy("component").agg(F.min("one").alias("keeper"))
    linked = parts.join(bounded(keepers, "keepers"), "component").select("vertex", "keeper")
    copied = vertices.where("copies > 1").select("vertex", F.col("one").alias("keeper")).join(linked.select("vertex"), "vertex", "left_anti")
    return sig, bounded(linked.unionByName(copied), "kept")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, n_shingles, component_id (smallest id reachable by links, its own included)."""
    sig, kept = classes(docs, k, percent, id_col, text_col)
    return sig.select("id", "n", "vertex").join(kept, "vertex", "left").select(
        F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.coalesce("keeper.id", "id").alias("component_id")
    )


def first_of_each_class(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that are the first of their class: the smallest id, at equal ids the smallest hash of the text, without an id last.

    Texts without shingles are all kept. Rows equal in id and text are one document
    and stay together.
    """
    sig, kept = classes(docs, k, percent, id_col, text_col)
    gone = sig.join(kept, "vertex").where(~(F.col("keeper.id").eqNullSafe(F.col("id")) & (F.col("keeper.mark") == F.col("mark"))))
    gone = bounded(gone.select(F.col("id").alias("gone id"), F.col("mark").alias("gone mark")).distinct(), "gone")
    return docs.join(gone, F.col(id_col).cast("long").eqNullSafe(F.col("gone id")) & (F.xxhash64(F.col(text_col).cast("string")) == F.col("gone mark")), "left_anti")
