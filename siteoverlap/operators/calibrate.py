"""False-positive rates of the tests under resampled candidates.

A replicate is one more grouping key: all replicates of all universes go through
the tests at once. The p-value table has scenario, universe_id, replicate, chrom.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hypergeom import overlap_pvalue, spread
from . import small
from .distances import distance_medians
from .overlap import window_id
from .profiles import arrow, dealt, expected_of, samples, summaries_of
from .resample import DRAWS, MOST_DRAWN, first_places, kept, prefix_of, sample_indices, sample_without_replacement, sizes

KEYS = ("scenario", "universe_id", "replicate")


def keyed(universe: DataFrame) -> DataFrame:
    """A universe with scenario and universe_id (the real one: empirical, 0)."""
    missing = {c: v for c, v in (("scenario", F.lit("empirical")), ("universe_id", F.lit(0))) if c not in universe.columns}
    return universe.withColumns(missing) if missing else universe


def overlap_pvalues(universe: DataFrame, sampled: DataFrame, methods: int) -> DataFrame:
    """KEYS, chrom, p_value of sampled candidates (KEYS, method, chrom, pos); only units that a sample hits are grouped.

    Chromosomes without any sampled unit have no row here; ``calibrate_overlap`` adds them. The number of universe units is counted once, not for each replicate.
    """
    by = ("scenario", "universe_id")
    total = universe.groupBy(*by, "chrom").agg(F.countDistinct("pos").alias("n_units"))
    full = (1 << methods) - 1
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("method") - 1)
    units = sampled.groupBy(*KEYS, "chrom", "pos").agg(F.bit_or(bit).alias("mask"))
    n = units.groupBy(*KEYS, "chrom").agg(
        F.array(*(F.sum((F.col("mask").bitwiseAND(1 << (m - 1)) != 0).cast("long")) for m in range(1, methods + 1))).alias("n_i"), F.count_if(F.col("mask") == full).alias("k_obs")
    )
    return spread(n.join(total, [*by, "chrom"]), *KEYS, "chrom").select(*KEYS, "chrom", overlap_pvalue("n_i", "n_units", "k_obs").alias("p_value"))


def places_in_common(sets: list[dict], have: int, methods: int) -> int:
    """How many places the samples (method, n, prefix) of all methods share; places of a method beyond them count for none."""
    if methods < 1 or not {*range(1, methods + 1)} <= {s["method"] for s in sets}:
        return 0
    common = None
    for beyond, n, prefix in sorted((not 1 <= s["method"] <= methods, s["n"], s["prefix"]) for s in sets):
        places = first_places(prefix.encode(), n, have)
        common = places if common is None else (np.setdiff1d if beyond else np.intersect1d)(common, places, assume_unique=True)
    return len(common)


def pvalues_by_place(units: DataFrame, counts: DataFrame, methods: int, replicates: int, seed: int, most: int = MOST_DRAWN) -> DataFrame:
    """``overlap_pvalues`` of samples of the index sampler, without a row for each site.

    Units are distinct, so samples share as many units as places. Those of a chromosome
    and replicate are drawn and compared in one task; chromosomes with a sample of more
    than ``most`` units go by rows.
    """
    on = [*KEYS[:2], "chrom"]
    size = sizes(units, counts.where("method is not null"), replicates, False, KEYS[:2]).withColumn("prefix", prefix_of(seed, KEYS[:2]))
    size = size.groupBy(*KEYS, "chrom", "have").agg(F.collect_list(F.struct("method", "n", "prefix")).alias("sets"), F.max("n").alias("n"))
    null = units.where("pos is null").select(*on, F.lit(1).alias("null"))  # a place, but no unit
    size = kept(size.join(null, on, "left").withColumn("n_units", F.col("have") - F.coalesce("null", F.lit(0))))
    rows = dealt(size.where(F.col("n") <= most).select(*KEYS, "chrom", "have", "n_units", "sets"), *KEYS, "chrom")
    columns = [*KEYS, "chrom", "n_units"]
    own, schema = arrow(rows.select(*columns), "n_i array<long>, k_obs long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = batch.column("sets").to_pylist()
            n = [[sum(x["n"] for x in s if x["method"] == m) for m in range(1, methods + 1)] for s in sets]
            k = [places_in_common(s, have, methods) for s, have in zip(sets, batch.column("have").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(n, pa.list_(pa.int64())), pa.array(k, pa.int64())], schema=own)

    few = rows.mapInArrow(run, schema).select(*KEYS, "chrom", overlap_pvalue("n_i", "n_units", "k_obs").alias("p_value"))
    larger = size.where(F.col("n") > most).select(*on).distinct()
    if larger.isEmpty():
        return few
    units = units.join(larger, on, "left_semi")
    return few.unionByName(overlap_pvalues(units, sample_indices(units, counts, replicates, seed, keys=KEYS[:2], most=most), methods))


def grid_of(universe: DataFrame, replicates: int) -> DataFrame:
    """KEYS, chrom: every replicate of every chromosome up to the last of each universe."""
    top = universe.groupBy("scenario", "universe_id").agg(F.max("chrom").alias("top")).where("top >= 1")
    rows = top.select("scenario", "universe_id", F.explode(F.sequence(F.lit(1), F.col("top"))).alias("chrom"))
    return rows.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).select(*KEYS, "chrom")


def units_of(universe: DataFrame, window: int) -> DataFrame:
    """scenario, universe_id, chrom, pos: the distinct units of each universe, windows from its first site on."""
    if window > 1:
        by = ["scenario", "universe_id", "chrom"]
        first = universe.groupBy(*by).agg(F.min("pos").alias("first_pos"))
        universe = universe.join(first, by).withColumn("pos", window_id(F.col("pos"), F.col("first_pos"), window))
    return universe.select("scenario", "universe_id", "chrom", "pos").distinct()


def calibrate_overlap(
    universe: DataFrame, counts: DataFrame, methods: int, replicates: int, seed: int, window: int = 1, test: Callable[[DataFrame, DataFrame, int], DataFrame] = overlap_pvalues, sampler: Callable = sample_without_replacement,
) -> DataFrame:
    """P-values of candidate sets of the given sizes (method, chrom, n), drawn from the units of each universe; ``test`` may be any test over replicates.

    With windows, as many windows are drawn as there were sites, at most all. Each
    replicate has a row for every chromosome of the universe, with p = 1 where
    nothing could be drawn. For many replicates take ``resample.sample_indices``.
    """
    universe = keyed(universe)
    units = units_of(universe, window)
    if test is overlap_pvalues and sampler is sample_indices:
        tested = pvalues_by_place(units, counts, methods, replicates, seed)
    else:
        tested = test(units, sampler(units, counts, replicates, seed, keys=KEYS[:2]), methods)
    return grid_of(universe, replicates).join(tested, [*KEYS, "chrom"], "left").select(*KEYS, "chrom", F.coalesce("p_value", F.lit(1.0)).alias("p_value"))


def tried_and_nulls(universe: DataFrame, counts: DataFrame, replicates: int, null_replicates: int, seed: int, sampler: Callable) -> DataFrame:
    """scenario, universe_id, chrom, of_null, replicate, entropy, median, e_median by blocks of ranks: the null replicates (of_null 1) and those held against them."""
    by = KEYS[:2]
    null = kept(samples(sampler(universe, counts, null_replicates, seed, keys=by), (*by, "replicate", "chrom")))
    expected = kept(expected_of(null, by))
    middle = distance_medians(expected, "avg_dist", (*by, "chrom")).withColumnRenamed("median", "e_median")
    tried = samples(sampler(universe, counts, replicates, seed + 1, keys=by), (*by, "replicate", "chrom"))
    rows = (summaries_of(x, expected, by).withColumn("of_null", F.lit(k)) for k, x in ((1, null), (0, tried)))
    return next(rows).unionByName(next(rows)).join(middle, [*by, "chrom"]).select(*by, "chrom", "of_null", "replicate", "entropy", "median", "e_median")


def calibrate_distance(universe: DataFrame, counts: DataFrame, replicates: int, null_replicates: int, seed: int, sampler: Callable = sample_without_replacement, most: int = small.MOST_DISTANCES) -> DataFrame:
    """P-values of the distance test in each universe: profile and null summaries once, then each replicate ranked among the nulls (rows in proportion to both numbers of replicates). Untestable chromosomes have p = 1."""
    universe, by = keyed(universe), KEYS[:2]
    on = [*by, "chrom"]
    rows = None
    if sampler in DRAWS:
        groups = kept(small.groups_of(universe, counts, max(replicates, null_replicates), False, by, most))
        rows = small.summaries(universe, groups, DRAWS[sampler], {1: (seed, null_replicates), 0: (seed + 1, replicates)}, by)
        large = groups.where("not small").select(*on)
        universe_ = universe.join(large, on, "left_semi")
    if rows is None or not large.isEmpty():
        by_blocks = tried_and_nulls(universe if rows is None else universe_, counts, replicates, null_replicates, seed, sampler)
        rows = by_blocks if rows is None else rows.unionByName(by_blocks)
    # a null that is wider than expected counts for no replicate; of the others those count that come no later in order of entropy
    rows = rows.where("of_null = 0 or median <= e_median")
    order = Window.partitionBy(*on).orderBy(F.desc("entropy")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    held = rows.withColumn("b", F.sum("of_null").over(order)).where("of_null = 0")
    p = F.when(F.col("median") > F.col("e_median"), 1.0).otherwise((F.col("b") + 1) / (null_replicates + 1))
    held = grid_of(universe, replicates).join(held.select(*KEYS, "chrom", p.alias("p")), [*KEYS, "chrom"], "left")
    return held.select(*KEYS, "chrom", F.coalesce("p", F.lit(1.0)).alias("p_value"))


def fp_rates(pvalues: DataFrame, alpha: float = 0.05) -> DataFrame:
    """scenario, universe_id, chrom (null: all), n, positives, rate: over everything, each universe, each chromosome, in one pass."""
    sets = pvalues.groupingSets([["scenario"], ["scenario", "universe_id"], ["scenario", "chrom"]], "scenario", "universe_id", "chrom")
    hit = (F.col("p_value") <= alpha).cast("int")
    return sets.agg(F.count("*").alias("n"), F.sum(hit).alias("positives"), F.avg(hit).alias("rate"))


def fwer(pvalues: DataFrame, alpha: float = 0.05) -> DataFrame:
    """scenario, universe_id (null: all), fwer, mean_sig, var_sig: share of replicates with any significant chromosome, and how many those are."""
    k = pvalues.groupBy(*KEYS).agg(F.count_if(F.col("p_value") <= alpha).alias("k_sig"))
    sets = k.groupingSets([["scenario"], ["scenario", "universe_id"]], "scenario", "universe_id")
    return sets.agg(F.avg((F.col("k_sig") > 0).cast("int")).alias("fwer"), F.avg("k_sig").alias("mean_sig"), F.var_pop("k_sig").alias("var_sig"))


def expected_fwer(chromosomes_tested: int, alpha: float = 0.05) -> float:
    """Under independence."""
    return 1 - (1 - alpha) ** chromosomes_tested


def fp_summary(rates: DataFrame) -> DataFrame:
    """scenario: mean, deviation, variance, number and standard error over universes; smallest, median and largest chromosome rate."""
    u = rates.where("universe_id is not null").groupBy("scenario").agg(
        F.avg("rate").alias("mean_rate"), F.stddev_samp("rate").alias("sd_rate"), F.var_samp("rate").alias("var_rate"), F.count("*").alias("n_eff")
    ).withColumn("se_rate", F.col("sd_rate") / F.sqrt("n_eff"))
    c = rates.where("chrom is not null").groupBy("scenario").agg(F.min("rate").alias("chrom_min"), F.percentile("rate", F.lit(0.5)).alias("chrom_median"), F.max("rate").alias("chrom_max"))
    return u.join(c, "scenario", "left")


def fp_top_chromosomes(rates: DataFrame, most: int = 10) -> DataFrame:
    """scenario, chrom, rate, rank of the chromosomes with the highest rates."""
    order = Window.partitionBy("scenario").orderBy(F.desc("rate"), "chrom")
    return rates.where("chrom is not null").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("scenario", "chrom", "rate", "rank")
