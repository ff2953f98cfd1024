"""The distance test of small chromosomes, all replicates of one in one go.

A chromosome whose sites are one short array, and the distances of all its replicates
a matrix of bounded size, needs no rows of samples, profiles or ranks: its universe and
candidates are shuffled once, and what comes out is a row for each replicate. Draws are
those of ``resample``. Larger chromosomes are left to the blocks of ``profiles``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import md5
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .profiles import arrow, dealt

#: Distances of all replicates of a chromosome, and its sites, up to which it is small; bytes of an Arrow batch.
MOST_DISTANCES, MOST_SITES, BATCH_BYTES = 1 << 21, 1 << 12, 1 << 21


def by_hash(prefix: bytes, n: int, pos: np.ndarray, names: list[bytes]) -> np.ndarray:
    """n of the sites, those of smallest md5(prefix name)."""
    if n == len(pos):
        return pos
    keys = [md5(prefix + x).digest() for x in names]
    return pos[sorted(range(len(keys)), key=keys.__getitem__)[:n]]


def names_of(pos: np.ndarray) -> list[bytes]:
    """Sorted sites as texts, with the number of the copy where one is repeated."""
    first = np.searchsorted(pos, pos)
    return [b"%d|%d" % (p, k) if k > 1 else b"%d" % p for p, k in zip(pos.tolist(), (np.arange(len(pos)) - first + 1).tolist(), strict=True)]


def sorted_distances(sides: list[np.ndarray]) -> np.ndarray:
    """A row of sorted distances between sites of different methods for each row of the sides (one for each method)."""
    return np.sort(np.concatenate([np.abs(x[:, :, None] - y[:, None, :]).reshape(len(x), -1) for x, y in combinations(sides, 2)], axis=1), axis=1)


def drawn_distances(draw: Callable, seed: int, replicates: int, chrom: int, pos: np.ndarray, names: list[bytes], sizes: list[dict]) -> np.ndarray:
    """The sorted distances of each replicate of a chromosome."""
    return sorted_distances([np.stack([draw(b"%d|%d|%d|%d|" % (seed, r, s["method"], chrom), min(s["n"], len(pos)), pos, names) for r in range(1, replicates + 1)]) for s in sizes])


def own_distances(own: list[dict], sizes: list[dict]) -> np.ndarray:
    """The sorted distances of the candidates of a chromosome, in one row."""
    return sorted_distances([np.array([[x["pos"] for x in own if x["method"] == s["method"]]]) for s in sizes])


def middle(profile: np.ndarray, truncate: bool) -> np.ndarray:
    """The median of each sorted row."""
    n = profile.shape[1]
    m = (profile[:, (n + 1) // 2 - 1] + profile[:, n // 2]) / 2
    return np.floor(m) if truncate else m


def entropies(dists: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Relative entropy of each row to the expected profile, as in ``profiles.summaries_of``."""
    d, p, sq = dists.astype(float), dists.sum(axis=1).astype(float), mean.sum()
    if len(mean) < 2 or sq <= 0:
        return np.zeros(len(d))
    terms = d * (np.log(np.maximum(d, 1.0)) - np.log(np.maximum(mean / sq, 1e-15)))
    return np.where(p > 0, terms.sum(axis=1) / np.maximum(p, 1.0) - np.log(np.maximum(p, 1.0)), 0.0)


def groups_of(universe: DataFrame, counts: DataFrame, replicates: int, strict: bool, keys: tuple[str, ...], most: int = MOST_DISTANCES) -> DataFrame:
    """keys, chrom, have, sizes (method, n), small; with ``strict`` a sample larger than its universe is an error."""
    n = counts.where("n > 0").groupBy(*(k for k in keys if k in counts.columns), "chrom").agg(
        F.array_sort(F.collect_list(F.struct(F.col("method").cast("int").alias("method"), F.col("n").cast("long").alias("n")))).alias("sizes"), (F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))).alias("twice")
    )
    have = universe.groupBy(*keys, "chrom").agg(F.count("*").alias("have"))
    rows = n.join(have, [c for c in n.columns if c not in ("sizes", "twice")], "left" if strict else "inner")
    small = (F.col("twice") * (replicates / 2) <= most) & (F.coalesce("have", F.lit(0)) <= MOST_SITES)
    if strict:
        larger = F.exists("sizes", lambda x: x["n"] > F.coalesce("have", F.lit(0)))
        small = F.when(larger, F.raise_error(F.lit("a sample is larger than its universe")).cast("boolean")).otherwise(small)
    return rows.select(*keys, "chrom", "have", "sizes", small.alias("small"))


def gathered(universe: DataFrame, groups: DataFrame, keys: tuple[str, ...], own: DataFrame | None) -> DataFrame:
    """keys, chrom, shift (of the seed), sites, sizes, own of the small groups: a row for each, dealt to all tasks."""
    on = [*keys, "chrom"]
    some = groups.where("small")
    rows = universe.select(*on, "pos").join(some.select(*on), on).groupBy(*on).agg(F.sort_array(F.collect_list(F.col("pos").cast("long"))).alias("sites")).join(some.select(*on, "sizes"), on)
    if own is None:
        rows = rows.withColumn("own", F.lit(None).cast("array<struct<method:int,pos:long>>"))
    else:
        site = F.struct(F.col("method").cast("int").alias("method"), F.col("pos").cast("long").alias("pos"))
        rows = rows.join(own.join(some.select(*on), on).groupBy(*on).agg(F.sort_array(F.collect_list(site)).alias("own")), on, "left")
    shift = F.col("universe_id").cast("long") if "universe_id" in keys else F.lit(0).cast("long")
    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return dealt(rows.select(*on, shift.alias("shift"), "sites", "sizes", "own"), *on, "shift")  # by other columns than above, or the few partitions of little data stay


def summaries(universe: DataFrame, groups: DataFrame, draw: Callable, seeds: dict[int, tuple[int, int]], keys: tuple[str, ...] = (), own: DataFrame | None = None, truncate: bool = False) -> DataFrame:
    """keys, chrom, of_null, replicate, entropy, median, e_median of the small groups.

    ``seeds``: of_null (1: the replicates that make up the expected profile, 0: those
    only held against it) to (seed, replicates). ``own`` (method, chrom, pos) are
    candidates held against it as replicate 0, in the sizes of the groups.
    """
    on, rows = [*keys, "chrom"], gathered(universe, groups, keys, own)
    fields, schema = arrow(rows.select(*on), "of_null int, replicate int, entropy double, median double, e_median double")

    def held(chrom: int, shift: int, pos: np.ndarray, sizes: list[dict], own: list[dict] | None) -> Iterator[tuple]:
        """of_null, replicates, entropies, medians and the expected median of one chromosome."""
        names = names_of(pos) if draw is by_hash else []
        drawn = {}
        for kind, (seed, replicates) in seeds.items():
            drawn[kind] = drawn_distances(draw, seed + shift, replicates, chrom, pos, names, sizes)
        mean = drawn[1].sum(axis=0) / len(drawn[1])
        expected = float(middle(mean[None], truncate)[0])
        for kind, dists in drawn.items():
            yield kind, range(1, len(dists) + 1), entropies(dists, mean), middle(dists, truncate), expected
        if own:
            dists = own_distances(own, sizes)
            yield 0, [0], entropies(dists, mean), middle(dists, truncate), expected

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, values, out = batch.column("sites").offsets.to_numpy(), batch.column("sites").values.to_numpy(), []
            for k, (chrom, shift, sizes, own) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("chrom", "shift", "sizes", "own")), strict=True)):
                if len(sizes) > 1:  # else no distances
                    out += [(k, *x) for x in held(chrom, shift, values[at[k] : at[k + 1]], sizes, own)]
            if out:
                row, kind, replicates, entropy, median, expected = zip(*out, strict=True)
                times = [len(x) for x in replicates]
                same = [batch.column(c).take(pa.array(np.repeat(row, times))) for c in on]
                more = (np.repeat(kind, times).astype(np.int32), np.concatenate(replicates).astype(np.int32), np.concatenate(entropy), np.concatenate(median), np.repeat(expected, times))
                yield pa.RecordBatch.from_arrays([*same, *map(pa.array, more)], schema=fields)

    return rows.mapInArrow(run, schema)


#: Distances of an output batch.
MOST_HELD = 1 << 18


def profiles_of(universe: DataFrame, groups: DataFrame, draw: Callable, seed: int, replicates: int, own: DataFrame) -> DataFrame:
    """chrom, observed, expected of the small groups: the sorted distances of the candidates ``own`` and the expected profile, an array each."""
    rows = gathered(universe, groups, (), own)
    fields, schema = arrow(rows.select("chrom"), "observed array<double>, expected array<double>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, values, out, held = batch.column("sites").offsets.to_numpy(), batch.column("sites").values.to_numpy(), [], 0
            for k, (chrom, sizes, sites) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("chrom", "sizes", "own")), strict=True)):
                if len(sizes) > 1:  # else no distances
                    pos = values[at[k] : at[k + 1]]
                    drawn = drawn_distances(draw, seed, replicates, chrom, pos, names_of(pos) if draw is by_hash else [], sizes)
                    out.append((chrom, own_distances(sites, sizes)[0].astype(float), drawn.sum(axis=0) / replicates))
                    held += len(out[-1][1]) + drawn.shape[1]
                if out and (held > MOST_HELD or k == batch.num_rows - 1):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), fields, strict=True)], schema=fields)
                    out, held = [], 0

    return rows.mapInArrow(run, schema)
