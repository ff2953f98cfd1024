"""Approximate nearest neighbours: NN-descent graph, greedy graph search.

Equal vectors are one vertex. The first graph comes from a few rounds in which
vertices near the same of a bounded set of pivots, dealt into blocks of bounded
size, are compared within their block. NN-descent then improves it: each vertex
joins its neighbours and a bounded sample of those it is a neighbour of, compares
them pairwise, and proposes the closer ones to each other; proposals are merged
into the lists of the K nearest, round after round until hardly a list changes
(there is no cap on the rounds; each is logged). Pairs of which neither came into a
list in the round before are not compared again, and a vertex without any new
neighbour sends nothing. A query walks the graph from its
own vertex and a few entries that all queries share: it keeps a beam of the nearest
vertices seen, expands all that are not expanded yet, and stops when the beam holds
nothing new. First rounds, pivots, entries and beam grow with the number of vertices.

Graph and search measure the original vectors in double precision; they travel as
floats where that loses nothing. Rows without an id and vectors that are null, zero
or hold null or non-finite components take no part. Vectors of different lengths are
compared as if zeros stood behind the shorter ones. Ties go to the smaller id; a
repeated (id, vector) counts once. Of several vectors with one id each is a row of its
own: as queries they get a list each, as candidates each may stand in a list, and only
the query's own row is left out of its list. Vertices are numbered in order of their
smallest id, never by it. An empty table gives an empty one. Only the id and vector
columns are read, so others may have any name.
"""

from __future__ import annotations

import logging
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .textio import small_batches, stored

#: Neighbours kept, sampled reverse neighbours, proposals of a vertex to each neighbour.
K, REVERSE, PROPOSALS = 28, 28, 8
#: Rounds for the first graph and pivots of a round (the least of each), vertices of a block.
ROUNDS, PIVOTS, BLOCK = 6, 64, 1024
#: Descent ends when a smaller share of the lists than this changes in a round.
STOP_SHARE = 0.02
#: Vertices that a query keeps (the least).
BEAM = 256
#: Bytes of query vectors that may be broadcast; more are joined by a shuffle.
BROADCAST_BYTES = 1 << 25

log = logging.getLogger(__name__)


def rounds_of(n: int) -> int:
    """Rounds for the first graph of n vertices: one for each doubling of the number of blocks."""
    return max(ROUNDS, (n // BLOCK).bit_length())


def pivots_of(n: int) -> int:
    """Pivots of a round; few vertices are not dealt out singly."""
    return max(1, min(4 * n // BLOCK, max(PIVOTS, isqrt(n) // 4)))


def beam_of(n: int) -> int:
    """Vertices that a query keeps: 16 for each doubling of the vertices."""
    return max(BEAM, 16 * n.bit_length())


def usable(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id, vec (array of double) of the rows that take part."""
    vec = F.col(vec_col).cast("array<double>")
    rows = rows.select(F.col(id_col).cast("long").alias("id"), vec.alias("vec")).where("id is not null and vec is not null and size(vec) > 0")
    rows = rows.where(F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0))
    ends = rows.agg(F.min(F.size("vec")), F.max(F.size("vec"))).first()
    if ends[0] != ends[1]:
        rows = rows.withColumn("vec", F.concat("vec", F.array_repeat(F.lit(0.0), F.lit(ends[1]) - F.size("vec"))))
    return rows.dropDuplicates(["id", "vec"])


def numbered(rows: DataFrame) -> DataFrame:
    """The rows with ``row``, different for each and growing with the id; stored, so that it stays what it is."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(parts, "id").sortWithinPartitions("id")
    return stored(rows.withColumn("row", F.monotonically_increasing_id()), "rows")


def members(rows: DataFrame, most: int) -> DataFrame:
    """id, vec, row, vertex, rank of the ``most`` first rows of each class of equal vectors; vertex is the number of the first.

    Ranked within 64 parts of a class first, so that one large class is no burden.
    """
    part = Window.partitionBy("vec", F.pmod(F.xxhash64("row"), F.lit(64))).orderBy("row")
    few = rows.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= most).drop("rank")
    whole = Window.partitionBy("vec").orderBy("row")
    few = few.withColumn("rank", F.row_number().over(whole)).where(F.col("rank") <= most)
    return few.withColumn("vertex", F.first("row").over(whole))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T), 0)


def lists(*columns: list[np.ndarray]) -> list[pa.Array]:
    """Ids, distances and marks of new ids as list columns."""
    at = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in columns[0]])]).astype(np.int32))
    flat = (np.concatenate([*c, np.zeros(0, k)]).astype(k) for c, k in zip(columns, (np.int64, float, bool), strict=True))
    return [pa.ListArray.from_arrays(at, pa.array(x)) for x in flat]


def nearest(ids: np.ndarray, dists: np.ndarray, fresh: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest of a list, each id once and new only if all its entries are; ties to the smaller id."""
    order = np.lexsort((fresh, ids))
    ids, dists, fresh = ids[order], dists[order], fresh[order]
    first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])) if len(ids) else order
    ids, dists, fresh = ids[first], dists[first], fresh[first]
    order = np.lexsort((ids, dists))[:k]
    return ids[order], dists[order], fresh[order]


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances along the last axis, without the cancellation of ``squared``."""
    return ((a - b) ** 2).sum(axis=-1)


def packed(vectors: DataFrame) -> tuple[DataFrame, str]:
    """vertex, code: the components as bytes, and their type: floats if no component changes by that, else doubles."""
    kind = "<f4" if vectors.where(F.exists("vec", lambda x: x.cast("float").cast("double") != x)).isEmpty() else "<f8"

    def run(batches):
        for batch in batches:
            m = matrix(batch.column(1)).astype(kind)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in m], pa.binary())], ["vertex", "code"])

    return vectors.select("vertex", "vec").mapInArrow(run, "vertex long, code binary"), kind


def unpacked(column, kind: str) -> np.ndarray:
    """The matrix of equally long values; of an Arrow column without a copy."""
    if not len(column):
        return np.zeros((0, 1), kind)
    if not isinstance(column, pa.Array):
        return np.frombuffer(b"".join(column), kind).reshape(len(column), -1)
    column = column.cast(pa.large_binary())
    _, at, data = column.buffers()
    at = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]].view(kind).reshape(len(column), -1)


def first_graph(codes: DataFrame, kind: str, k: int) -> DataFrame:
    """vertex, ids, dists from comparisons within blocks."""
    n = codes.count()
    rounds = rounds_of(n)
    pivots = [codes.orderBy(F.xxhash64("vertex", F.lit(r)), "vertex").limit(pivots_of(n)) for r in range(rounds)]
    pivots = [unpacked([bytes(x["code"]) for x in p.collect()], kind).astype(float) for p in pivots]

    def cells(batches):
        for batch in batches:
            m = unpacked(batch.column(1), kind).astype(float)
            near = [pa.array(squared(m, p).argmin(axis=1).astype(np.int32)) for p in pivots]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *near], ["vertex", "code", *(f"c{r}" for r in range(rounds))])

    dealt = codes.mapInArrow(cells, "vertex long, code binary, " + ", ".join(f"c{r} int" for r in range(rounds)))
    dealt = dealt.select("vertex", "code", F.posexplode(F.array(*(f"c{r}" for r in range(rounds)))).alias("round", "cell"))
    size = dealt.groupBy("round", "cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = dealt.join(F.broadcast(size), ["round", "cell"]).withColumn("block", F.pmod(F.xxhash64("vertex", "round"), F.col("blocks")))  # one row a pivot

    def compare(group):
        ids, m = group["vertex"].to_numpy(), unpacked(group["code"], kind).astype(float)
        keep = min(k, len(ids) - 1)
        mid = m - np.median(m, axis=0)
        d = squared(mid, mid)
        np.fill_diagonal(d, np.inf)
        near = np.argpartition(d, keep - 1, axis=1)[:, :keep] if keep else np.zeros((len(ids), 0), int)
        dists = np.stack([exact(m, m[x]) for x in near.T], axis=1) if keep else np.zeros((len(ids), 0))
        import pandas as pd

        return pd.DataFrame({"vertex": ids, "ids": list(ids[near]), "dists": list(dists)})

    found = dealt.groupBy("round", "cell", "block").applyInPandas(compare, "vertex long, ids array<long>, dists array<double>")
    return merged(found.withColumn("fresh", F.transform("ids", lambda _: F.lit(True))), k)


LISTS = "vertex long, ids array<long>, dists array<double>, fresh array<boolean>"


def best_of(lists_: DataFrame, k: int) -> DataFrame:
    """The K nearest of each row's list."""

    def run(batches):
        for batch in batches:
            at = batch.column(1).offsets.to_numpy()
            ids, dists, fresh = (batch.column(c).values.to_numpy(zero_copy_only=False) for c in (1, 2, 3))
            best = [nearest(ids[a:b], dists[a:b], fresh[a:b], k) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists(*([x[c] for x in best] for c in range(3)))], ["vertex", "ids", "dists", "fresh"])

    return lists_.select("vertex", "ids", "dists", "fresh").mapInArrow(run, LISTS)


def merged(lists_: DataFrame, k: int) -> DataFrame:
    """The K nearest of all lists of a vertex."""
    every = lists_.groupBy("vertex").agg(*(F.flatten(F.collect_list(c)).alias(c) for c in ("ids", "dists", "fresh")))
    return best_of(every, k)


def marked(new: bool):
    """For ``transform``: an id with its mark."""
    return lambda u: F.struct(u.alias("u"), F.lit(new).alias("new"))


def descent(graph: DataFrame, codes: DataFrame, kind: str, k: int, turn: int) -> DataFrame:
    """One round of NN-descent: neighbours of a vertex are proposed to each other, where one of them is new."""
    out = graph.select(F.col("vertex").alias("v"), F.explode(F.arrays_zip("ids", "fresh")).alias("to")).select("v", F.col("to.ids").alias("u"), F.col("to.fresh").alias("new"))
    back = Window.partitionBy("v").orderBy(F.desc("new"), F.xxhash64("v", "u", F.lit(turn)))
    into = out.select(F.col("u").alias("v"), F.col("v").alias("u"), "new").withColumn("rank", F.row_number().over(back)).where(F.col("rank") <= REVERSE).drop("rank")
    around = out.unionByName(into).groupBy("v").agg(*(F.collect_set(F.when(c, F.col("u"))).alias(n) for n, c in (("news", F.col("new")), ("olds", ~F.col("new")))))
    olds = F.array_union(F.array("v"), F.array_except("olds", "news"))
    around = around.where(F.size("news") > 0).select("v", F.explode(F.concat(F.transform("news", marked(True)), F.transform(olds, marked(False)))).alias("to"))
    worst = graph.select(F.col("vertex").alias("u"), F.when(F.size("ids") >= k, F.element_at("dists", -1)).otherwise(F.lit(float("inf"))).alias("worst"))
    known = codes.withColumnRenamed("vertex", "u").join(worst, "u")
    groups = around.select("v", "to.u", "to.new").join(known, "u").groupBy("v").agg(F.collect_list(F.struct("u", "code", "worst", "new")).alias("near"))  # at most 1 + K + REVERSE each

    def run(batches):
        for batch in batches:
            near = batch.column(1)
            at, fields = near.offsets.to_numpy(), near.values
            ids, worst, m = fields.field("u").to_numpy(), fields.field("worst").to_numpy(), unpacked(fields.field("code"), kind)
            new = fields.field("new").to_numpy(zero_copy_only=False)
            who, what, how = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
            for v, a, b in zip(batch.column(0).to_numpy(), at[:-1], at[1:], strict=True):
                raw, fresh = m[a:b].astype(float), new[a:b]
                own = raw - raw[ids[a:b] == v]  # around the vertex nothing cancels
                d = squared(own, own)
                np.fill_diagonal(d, np.inf)
                d[~(fresh[:, None] | fresh[None])] = np.inf
                keep = min(PROPOSALS, b - a - 1)
                if keep < 1:
                    continue
                best = np.argpartition(d, keep - 1, axis=1)[:, :keep]
                far = exact(raw[:, None], raw[best])
                row, col = np.nonzero((far < worst[a:b, None]) & np.isfinite(np.take_along_axis(d, best, axis=1)))
                who.append(ids[a + row])
                what.append(ids[a + best[row, col]])
                how.append(far[row, col])
            who, what, how = np.concatenate(who), np.concatenate(what), np.concatenate(how)
            order = np.lexsort((what, who))
            who, what, how = who[order], what[order], how[order]
            one = np.ones(len(who), bool)
            one[1:] = (who[1:] != who[:-1]) | (what[1:] != what[:-1])
            who, what, how = who[one], what[one], how[one]
            start = np.flatnonzero(np.append(True, who[1:] != who[:-1])) if len(who) else np.zeros(0, np.int64)
            bound = pa.array(np.append(start, len(who)).astype(np.int32))
            cols = [pa.ListArray.from_arrays(bound, pa.array(x)) for x in (what, how, np.ones(len(who), bool))]
            yield pa.RecordBatch.from_arrays([pa.array(who[start]), *cols], ["vertex", "ids", "dists", "fresh"])

    proposed = best_of(groups.mapInArrow(run, LISTS), k)
    old = graph.withColumn("fresh", F.transform("ids", lambda _: F.lit(False)))
    return merged(old.unionByName(proposed), k)


def changed(before: DataFrame, after: DataFrame) -> float:
    """Share of the lists with a vertex that they did not hold before."""
    both = after.join(before.select("vertex", F.col("ids").alias("old")), "vertex")
    return both.agg(F.avg((F.size(F.array_except("ids", "old")) > 0).cast("double"))).first()[0] or 0.0


def neighbour_graph(vectors: DataFrame, k: int = K) -> DataFrame:
    """vertex, ids, dists, fresh (which ids the last round brought): about the K nearest vertices of each. Lists only ever improve, so that the rounds end."""
    codes, kind = packed(vectors)
    codes = stored(codes, "codes")
    graph = stored(first_graph(codes, kind, k), "graph")
    turn, share = 0, 1.0
    while share >= STOP_SHARE:
        after = stored(descent(graph, codes, kind, k, turn), "graph")
        share = changed(graph, after)
        graph, turn = after, turn + 1
        log.info("round %d of the descent: %.4f of the lists changed", turn, share)
    return graph


def search(starts: DataFrame, vectors: DataFrame, graph: DataFrame, beam: int) -> DataFrame:
    """q, x, dist: the vertices in each query's beam when it holds nothing left to expand. starts: q, vec, from (vertices).

    What a query has met and not kept is no nearer than its beam's last, and the beam
    only gets nearer; so each hop looks at the beams alone, not at all that was met.
    """
    asked = starts.select("q", F.col("vec").alias("want"))
    size = starts.agg(F.count("*") * F.coalesce(F.max(F.size("vec")), F.lit(0)) * 8).first()[0]
    asked = F.broadcast(asked) if size <= BROADCAST_BYTES else asked
    starts = starts.select("q", F.explode("from").alias("x")).distinct()
    # both directions of an edge can be walked; of those into a vertex, a bounded sample
    back = Window.partitionBy("w").orderBy(F.xxhash64("w", "x"))
    edges = graph.select(F.col("vertex").alias("w"), F.explode("ids").alias("x"))
    into = edges.select(F.col("x").alias("w"), F.col("w").alias("x")).withColumn("rank", F.row_number().over(back)).where(F.col("rank") <= REVERSE).drop("rank")
    ways = stored(edges.union(into).groupBy("w").agg(F.collect_set("x").alias("xs")), "ways")

    def measured(pairs: DataFrame) -> DataFrame:
        both = pairs.join(vectors.select(F.col("vertex").alias("x"), "vec"), "x").join(asked, "q").select("q", "x", "vec", "want")

        def run(batches):
            for batch in batches:
                d = np.sqrt(((matrix(batch.column(2)) - matrix(batch.column(3))) ** 2).sum(axis=1)) if batch.num_rows else np.zeros(0)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(d)], ["q", "x", "dist"])

        return both.mapInArrow(run, "q long, x long, dist double")

    held = stored(measured(starts).withColumn("done", F.lit(False)), "held")
    order = Window.partitionBy("q").orderBy("dist", "x")
    while True:
        todo = held.where("not done").select("q", F.col("x").alias("w"))
        if todo.isEmpty():
            return held.select("q", "x", "dist")
        met = todo.join(ways, "w").select("q", F.explode("xs").alias("x")).distinct().join(held.select("q", "x"), ["q", "x"], "left_anti")
        fresh = stored(measured(met), "fresh")  # a stage of its own, or sorting and Arrow's buffers meet in one task
        both = held.withColumn("done", F.lit(True)).unionByName(fresh.withColumn("done", F.lit(False)))
        held = stored(both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= beam).select("q", "x", "dist", "done"), "held")


def nearest_neighbours(rows: DataFrame, queries: DataFrame, n: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", beam: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the n nearest rows found for each row of ``queries`` (ids among ``rows``), without itself."""
    small_batches(rows.sparkSession)
    rows = numbered(usable(rows, id_col, vec_col))
    own = stored(members(rows, n + 1).select("id", "vec", "row", "vertex", "rank"), "members")
    vectors = stored(own.where("rank = 1").select("vertex", "vec"), "vectors")
    n_vertices = vectors.count()
    if not n_vertices:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    graph = neighbour_graph(vectors)
    entries = [r["vertex"] for r in vectors.select("vertex").orderBy(F.xxhash64("vertex"), "vertex").limit(n_vertices.bit_length()).collect()]
    asked = rows.join(queries.select(F.col(id_col).cast("long").alias("id")).distinct(), "id", "left_semi")
    asked = asked.join(vectors.withColumnRenamed("vec", "same"), F.col("vec") == F.col("same"))
    asked = stored(asked.select(F.col("id").alias("query_id"), F.col("row").alias("asker"), "vertex", "vec"), "asked")
    starts = asked.select(F.col("vertex").alias("q"), "vec", F.array_union(F.array("vertex"), F.lit(entries).cast("array<long>")).alias("from")).dropDuplicates(["q"])
    found = search(starts, vectors, graph, beam or beam_of(n_vertices))
    near = Window.partitionBy("q").orderBy("dist", "x")
    found = found.withColumn("place", F.row_number().over(near)).where(F.col("place") <= n + 1).select("q", "x", "dist")
    every = asked.select("query_id", "asker", F.col("vertex").alias("q")).join(found, "q").join(own.select(F.col("vertex").alias("x"), F.col("id").alias("vec_id"), "row"), "x")
    best = Window.partitionBy("asker").orderBy("dist", "vec_id", "row")
    every = every.where("row <> asker").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n)
    return every.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.col("dist").alias("score"))
