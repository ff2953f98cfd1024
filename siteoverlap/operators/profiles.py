"""Sorted distances between the sites of different methods, by blocks of ranks.

The distances of a sample (all pairs of sites of different methods) are never
shuffled. What travels is the sample itself, one row for each (group, replicate) and
block of ``BLOCK`` ranks; the block's distances are found where they are needed: how
many pairs are at most d apart is a matter of binary searches in sorted positions, so
the distances that bound a block are found by halving, and only pairs between them
are made and sorted. Distances equal to a bound are counted, not made, so a block is
never larger, however often one distance occurs. Ranks are exact and no window runs
over a group.

Blocks of equal ranks add up over replicates: the expected profile takes one sum for
each block and ``CHUNK`` replicates, and a second pass holds each replicate's blocks
against it. Draws are pure functions of their keys, so both passes see the same.

A sample's sites are one row, its pairs are not: memory follows the sites of one
sample and the blocks. Repeated sites count each time. A group with sites of one
method only has no distances and no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ranks of a block, and replicates that one task sums up.
BLOCK, CHUNK = 1 << 16, 256


class Sample:
    """The sites of one sample, by method in order of position."""

    def __init__(self, method: np.ndarray, pos: np.ndarray):
        order = np.lexsort((pos, method))
        method, pos = method[order], pos[order]
        sides = np.split(pos, np.flatnonzero(np.diff(method)) + 1)
        self.pairs = [(x, y) if len(x) <= len(y) else (y, x) for x, y in combinations(sides, 2)]
        self.total = sum(len(x) * len(y) for x, y in self.pairs)

    def up_to(self, d: int) -> int:
        """Distances of at most d."""
        return sum(int((np.searchsorted(y, x + d, "right") - np.searchsorted(y, x - d, "left")).sum()) for x, y in self.pairs) if d >= 0 else 0

    def at(self, rank: int) -> int:
        """The distance at a rank (from 1)."""
        low, high = -1, max(max(abs(int(y[-1]) - int(x[0])), abs(int(x[-1]) - int(y[0]))) for x, y in self.pairs)
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (low, mid) if self.up_to(mid) >= rank else (mid, high)
        return high

    def between(self, low: int, high: int) -> np.ndarray:
        """All distances above low and below high (low >= 0)."""
        found = []
        for x, y in self.pairs:
            for a, b in ((np.searchsorted(y, x + low, "right"), np.searchsorted(y, x + high, "left")), (np.searchsorted(y, x - high, "right"), np.searchsorted(y, x - low, "left"))):
                n = np.maximum(b - a, 0)
                at = np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())
                found.append(np.abs(y[at] - np.repeat(x, n)))
        return np.sort(np.concatenate(found))

    def block(self, number: int, size: int = BLOCK) -> np.ndarray:
        """The sorted distances of a block of so many ranks."""
        first, last = number * size, min(self.total, (number + 1) * size)
        if self.total <= size:
            return np.sort(np.concatenate([np.abs(np.subtract.outer(x, y)).ravel() for x, y in self.pairs])) if self.pairs else np.zeros(0, np.int64)
        low, high = self.at(first + 1), self.at(last)
        if low == high:
            return np.full(last - first, low)
        inner = self.between(low, high)
        lows = self.up_to(low) - first
        return np.concatenate([np.full(lows, low), inner, np.full(last - first - lows - len(inner), high)])


def pairs_of(sites: Column) -> Column:
    """How many pairs of different methods an array of (method, pos) has."""
    methods = F.array_distinct(F.transform(sites, lambda s: s["method"]))
    n = F.transform(methods, lambda m: F.size(F.filter(sites, lambda s: s["method"] == m)).cast("long"))
    total = F.size(sites).cast("long")
    return ((total * total - F.aggregate(n, F.lit(0).cast("long"), lambda a, x: a + x * x)) / 2).cast("long")


def samples(candidates: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys, sites, n_pairs: one row for the sites of each of the keys."""
    rows = candidates.groupBy(*keys).agg(F.collect_list(F.struct(F.col("method").cast("int").alias("method"), F.col("pos").cast("long").alias("pos"))).alias("sites"))
    return rows.withColumn("n_pairs", pairs_of(F.col("sites"))).where("n_pairs > 0")


def in_blocks(rows: DataFrame, block: int) -> DataFrame:
    """One row for each block of a sample."""
    last = F.floor((F.col("n_pairs") - 1) / block).cast("int")
    return rows.withColumn("block", F.explode(F.sequence(F.lit(0), last)))


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows by keys, in as many partitions as shuffles have: little data, but much work for each row."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def each_sample(batch: pa.RecordBatch) -> Iterator[Sample]:
    """The samples of the rows' ``sites``."""
    sites = batch.column("sites")
    at, fields = sites.offsets.to_numpy(), sites.values
    method, pos = (fields.field(k).to_numpy(zero_copy_only=False) for k in ("method", "pos"))
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        yield Sample(method[a:b], pos[a:b])


def arrow(rows: DataFrame, more: str) -> tuple[pa.Schema, object]:
    """The schema of the rows' columns and of more: for Arrow and for Spark."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    schema = StructType([*rows.schema.fields, *_parse_datatype_string(more).fields])
    return to_arrow_schema(schema), schema


def profile_of(candidates: DataFrame, keys: tuple[str, ...] = ("chrom",), block: int = BLOCK) -> DataFrame:
    """keys, rnk, dist: the distances of each of the keys by rank; blocks of one group are spread over tasks."""
    rows = in_blocks(samples(candidates, keys), block)
    rows = dealt(rows, *keys, "block")
    own, schema = arrow(rows.select(*keys), "first long, dists array<long>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, sample in enumerate(each_sample(batch)):
                number = batch.column("block")[k].as_py()
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(k, 1) for c in keys), pa.array([number * block]), pa.array([sample.block(number, block)], pa.list_(pa.int64()))], schema=own)

    dists = rows.mapInArrow(run, schema).select(*keys, "first", F.posexplode("dists").alias("at", "dist"))
    return dists.select(*keys, (F.col("first") + F.col("at") + 1).cast("long").alias("rnk"), "dist")


def expected_of(drawn: DataFrame, keys: tuple[str, ...] = (), block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """keys, chrom, rnk, avg_dist: the mean over replicates of the distance at each rank. drawn: keys, chrom, replicate, sites, n_pairs.

    A task adds up the blocks of up to ``chunk`` replicates, so what is shuffled is a
    row for each rank and chunk, not for each rank and replicate.
    """
    on = (*keys, "chrom")
    rows = in_blocks(drawn, block).withColumn("chunk", F.floor(F.col("replicate") / chunk).cast("int"))
    rows = dealt(rows, *on, "block", "chunk").sortWithinPartitions(*on, "block", "chunk")
    own, schema = arrow(rows.select(*on), "first long, n long, sums array<double>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, keep, total, n = None, None, None, 0

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*keep, pa.array([group[-2] * block]), pa.array([n]), pa.array([total], pa.list_(pa.float64()))], schema=own)

        for batch in batches:
            names = list(zip(*(batch.column(c).to_pylist() for c in (*on, "block", "chunk")), strict=True))
            for k, sample in enumerate(each_sample(batch)):
                dists = sample.block(names[k][-2], block)
                if names[k] == group and len(dists) == len(total):
                    total, n = total + dists, n + 1
                    continue
                if group is not None:
                    yield done()
                group, keep, total, n = names[k], [batch.column(c).slice(k, 1) for c in on], dists.astype(float), 1
        if group is not None:
            yield done()

    sums = rows.mapInArrow(run, schema).select(*on, "first", "n", F.posexplode("sums").alias("at", "sum"))
    sums = sums.groupBy(*on, (F.col("first") + F.col("at") + 1).cast("long").alias("rnk"))
    return sums.agg((F.sum("sum") / F.sum("n")).alias("avg_dist"))


def summaries_of(drawn: DataFrame, expected: DataFrame, keys: tuple[str, ...] = (), truncate: bool = False, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """keys, replicate, chrom, entropy, median of each sample against the expected profile. drawn: as in ``expected_of``.

    Entropy: both profiles normalised to sum 1, 0 where one has fewer than two ranks or
    no distance. A sample of another length than its expected profile is an error.
    The rows of a block come sorted, the expected distances first, replicates after.
    """
    on = (*keys, "chrom")
    sums = expected.groupBy(*on).agg(F.sum("avg_dist").alias("sq"), F.count("*").alias("length"))
    q = expected.withColumn("block", F.floor((F.col("rnk") - 1) / block).cast("int")).groupBy(*on, "block")
    q = q.agg(F.transform(F.array_sort(F.collect_list(F.struct("rnk", "avg_dist"))), lambda x: x["avg_dist"]).alias("q"))
    rows = in_blocks(drawn, block).withColumn("chunk", F.floor(F.col("replicate") / chunk).cast("int"))
    chunks = rows.select(*on, "block", "chunk").distinct()
    q = q.join(sums, list(on)).join(chunks, [*on, "block"])
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    q = q.select(*on, none("int", "replicate"), "block", "chunk", none(dict(drawn.dtypes)["sites"], "sites"), none("long", "n_pairs"), "q", "sq")
    rows = rows.select(*on, F.col("replicate").cast("int").alias("replicate"), "block", "chunk", "sites", "n_pairs", none("array<double>", "q"), none("double", "sq"))
    rows = dealt(rows.unionByName(q), *on, "block", "chunk").sortWithinPartitions(*on, "block", "chunk", F.col("replicate").asc_nulls_first())
    parts = "p double, plp double, plq double, n long, middle double, middles long"
    own, schema = arrow(rows.select(*on, "replicate"), parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, lq, length = None, np.zeros(0), 0
        for batch in batches:
            names = list(zip(*(batch.column(c).to_pylist() for c in (*on, "block", "chunk")), strict=True))
            keep, out = [], []
            for k, sample in enumerate(each_sample(batch)):
                if batch.column("replicate")[k].as_py() is None:
                    q, sq = batch.column("q")[k].values.to_numpy(), batch.column("sq")[k].as_py()
                    group, lq = names[k], np.log(np.maximum(q / sq, 1e-15)) if sq > 0 else np.full(len(q), np.nan)
                    continue
                d = sample.block(names[k][-2], block).astype(float)
                if names[k] != group or len(d) != len(lq):
                    raise ValueError("profiles of different length")
                some, first = d[d > 0], names[k][-2] * block
                middle = {r - 1 - first for r in ((sample.total + 1) // 2, sample.total // 2 + 1)}
                middle = [d[r] for r in middle if 0 <= r < len(d)]
                keep.append(k)
                out.append((d.sum(), (some * np.log(some)).sum(), (some * lq[d > 0]).sum(), len(d), sum(middle), len(middle)))
            cols = [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), [own.field(x.split()[0]) for x in parts.split(", ")], strict=True)] if out else []
            if out:
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(keep)) for c in (*on, "replicate")), *cols], schema=own)

    found = rows.mapInArrow(run, schema).groupBy(*keys, "replicate", "chrom").agg(*(F.sum(c).alias(c) for c in ("p", "plp", "plq", "n", "middle", "middles")))
    # without any expected distance the logarithms above are NaN
    ok = (F.col("n") >= 2) & (F.col("p") > 0) & ~F.isnan("plq")
    entropy = F.when(ok, (F.col("plp") - F.col("plq")) / F.col("p") - F.ln("p")).otherwise(0.0)
    median = F.col("middle") / F.col("middles")
    found = found.join(sums.select(*on, "length"), list(on))
    entropy = F.when(F.col("n") == F.col("length"), entropy).otherwise(F.raise_error(F.lit("profiles of different length")).cast("double"))
    return found.select(*keys, "replicate", "chrom", entropy.alias("entropy"), (F.floor(median).cast("double") if truncate else median).alias("median"))
