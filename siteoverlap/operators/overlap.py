"""k-way overlap of candidate sets within a universe, in one shuffle on (chrom, unit).

A unit is a position, or with ``window`` > 1 an occupied window of positions
counted from the chromosome's first universe site. Universe and candidates are
tagged and grouped once; every count falls out of the flags of a unit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hypergeom import overlap_pvalue, spread
from .summary import chromosomes


def window_id(pos: Column, first: Column, window: int) -> Column:
    """floor((pos - first) / window); negative before the first site."""
    return F.floor((pos - first) / F.lit(window))


def with_units(sites: DataFrame, universe: DataFrame, window: int) -> DataFrame:
    """Adds ``unit``; one row of the joined side for each chromosome."""
    if window == 1:
        return sites.withColumn("unit", F.col("pos"))
    first = universe.groupBy("chrom").agg(F.min("pos").alias("first_pos"))
    return sites.join(first, "chrom", "left").withColumn("unit", window_id(F.col("pos"), F.coalesce("first_pos", F.lit(0)), window)).drop("first_pos")


def unit_flags(universe: DataFrame, candidates: DataFrame, window: int = 1, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, chrom, unit, in_universe, mask (bit i - 1: method i). ``keys`` (as replicate) are columns of the candidates only if the universe has them too."""
    u = with_units(universe.select(*keys, "chrom", "pos"), universe, window).select(*keys, "chrom", "unit", F.lit(1).alias("in_u"), F.lit(0).cast("long").alias("bit"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("method") - 1)
    c = with_units(candidates.select(*keys, "method", "chrom", "pos"), universe, window).select(*keys, "chrom", "unit", F.lit(0).alias("in_u"), bit.alias("bit"))
    return u.unionByName(c).groupBy(*keys, "chrom", "unit").agg((F.max("in_u") == 1).alias("in_universe"), F.bit_or("bit").alias("mask"))


def has(method: int) -> Column:
    return F.col("mask").bitwiseAND(1 << (method - 1)) != 0


def overlap_counts(flags: DataFrame, axis: DataFrame, methods: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, chrom, n_units, n_i (array by method), k_obs, missing_n and missing_min (arrays), dense over the axis."""
    full = (1 << methods) - 1
    one = lambda c: F.sum(c.cast("long"))
    counted = flags.groupBy(*keys, "chrom").agg(
        one(F.col("in_universe")).alias("n_units"),
        F.array(*(one(F.col("in_universe") & has(m)) for m in range(1, methods + 1))).alias("n_i"),
        one(F.col("in_universe") & (F.col("mask") == full)).alias("k_obs"),
        F.array(*(one(~F.col("in_universe") & has(m)) for m in range(1, methods + 1))).alias("missing_n"),
        F.array(*(F.min(F.when(~F.col("in_universe") & has(m), F.col("unit"))) for m in range(1, methods + 1))).alias("missing_min"),
    )
    if keys:
        return counted
    zero = F.array_repeat(F.lit(0).cast("long"), methods)
    return axis.join(counted, "chrom", "left").select(
        "chrom", F.coalesce("n_units", F.lit(0)).alias("n_units"), F.coalesce("n_i", zero).alias("n_i"), F.coalesce("k_obs", F.lit(0)).alias("k_obs"),
        F.coalesce("missing_n", zero).alias("missing_n"), F.coalesce("missing_min", F.array_repeat(F.lit(None).cast("long"), methods)).alias("missing_min"),
    )


def expected_overlap(sizes: Column, total: Column) -> Column:
    """Product of the set sizes over total^(k - 1); null without units."""
    product = F.aggregate(sizes, F.lit(1.0), lambda a, x: a * x)
    return F.when(total > 0, product / F.pow(total, F.size(sizes) - 1))


def overlap_warnings(total: Column, missing_n: Column, missing_min: Column, methods: int) -> Column:
    """What makes a chromosome's test doubtful, as an array of texts."""
    size = F.when(total <= 1, "degenerate universe").when(total < 10, "very small universe").when(total < 20, "small universe")
    absent = [
        F.when(missing_n[m] > 0, F.concat_ws(" ", F.lit(f"method {m + 1}:"), missing_n[m].cast("string"), F.lit("not in the universe, first"), missing_min[m].cast("string"))) for m in range(methods)
    ]
    return F.array_compact(F.array(size, *absent))


def overlap_test(universe: DataFrame, candidates: DataFrame, methods: int, window: int = 1) -> DataFrame:
    """chrom, n_units, n_i, k_obs, expected_k, p_value, warnings, missing: one row a chromosome."""
    counts = overlap_counts(unit_flags(universe, candidates, window), chromosomes(universe, candidates), methods)
    return spread(counts, "chrom").select(
        "chrom", "n_units", "n_i", "k_obs", expected_overlap(F.col("n_i"), F.col("n_units")).alias("expected_k"), overlap_pvalue("n_i", "n_units", "k_obs").alias("p_value"),
        overlap_warnings(F.col("n_units"), F.col("missing_n"), F.col("missing_min"), methods).alias("warnings"), F.exists("missing_n", lambda x: x > 0).alias("missing"),
    )


def missing_from_universe(universe: DataFrame, candidates: DataFrame, window: int = 1) -> DataFrame:
    """method, chrom, n_missing, first_missing: distinct candidate units that the universe lacks."""
    u = with_units(universe, universe, window).select("chrom", "unit").distinct()
    c = with_units(candidates, universe, window).select("method", "chrom", "unit").distinct()
    return c.join(u, ["chrom", "unit"], "left_anti").groupBy("method", "chrom").agg(F.count("*").alias("n_missing"), F.min("unit").alias("first_missing"))


def in_universe(universe: DataFrame, candidates: DataFrame, window: int = 1) -> DataFrame:
    """The candidates whose unit is in the universe."""
    u = with_units(universe, universe, window).select("chrom", "unit").distinct()
    return with_units(candidates, universe, window).join(u, ["chrom", "unit"], "left_semi")
