"""Counts and descriptive statistics of site tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .order import percentiles, places


def only_numbered(sites: DataFrame) -> DataFrame:
    """Chromosome ids below 1 do not exist."""
    return sites.where("chrom >= 1")


def one_chromosome(sites: DataFrame, chrom: int | None) -> DataFrame:
    """A filter that reaches the scan; None keeps all."""
    return sites if chrom is None else sites.where(F.col("chrom") == chrom)


def chromosomes(*tables: DataFrame) -> DataFrame:
    """chrom: 1 to the largest id of any of the tables."""
    top = tables[0].agg(F.max("chrom").alias("top"))
    for t in tables[1:]:
        top = top.union(t.agg(F.max("chrom")))
    return top.agg(F.max("top").alias("top")).where("top >= 1").select(F.explode(F.sequence(F.lit(1), F.col("top"))).alias("chrom"))


def site_counts(candidates: DataFrame) -> DataFrame:
    """method, chrom, n and, with chrom 0, the total of each method; one shuffle."""
    counted = candidates.rollup("method", "chrom").agg(F.count("*").alias("n"), F.grouping("chrom").alias("total")).where("method is not null")
    return counted.select("method", F.when(F.col("total") == 1, 0).otherwise(F.col("chrom")).cast("int").alias("chrom"), "n")


def dense_counts(candidates: DataFrame, axis: DataFrame, methods: int) -> DataFrame:
    """method, chrom, n over the full grid, zeros included."""
    grid = axis.select("chrom", F.explode(F.sequence(F.lit(1), F.lit(methods))).alias("method"))
    n = candidates.groupBy("method", "chrom").agg(F.count("*").alias("n"))
    return grid.join(n, ["method", "chrom"], "left").select("method", "chrom", F.coalesce("n", F.lit(0)).alias("n"))


def chromosome_totals(sites: DataFrame) -> DataFrame:
    """chrom, total: all rows of each chromosome, as the reports give for the universe."""
    return sites.groupBy("chrom").agg(F.count("*").alias("total"))


def site_stats(sites: DataFrame) -> DataFrame:
    """Per (method, chrom): smallest, largest, range, mean, population deviation and median position."""
    by = ("method", "chrom")
    stats = sites.groupBy(*by).agg(
        F.min("pos").alias("min_pos"), F.max("pos").alias("max_pos"), (F.max("pos") - F.min("pos") + 1).alias("range_bp"), F.avg("pos").alias("mean_pos"), F.stddev_pop("pos").alias("sd_pos")
    )
    middle = percentiles(places(sites.select(*by, "pos"), by, "pos"), by, "pos", (0.5,))
    return stats.join(middle.select(*by, F.col("q")[0].alias("median_pos")), list(by))


def range_stats(stats: DataFrame) -> DataFrame:
    """Mean and population deviation of the ranges of each method."""
    return stats.groupBy("method").agg(F.avg("range_bp").alias("mean_range"), F.stddev_pop("range_bp").alias("sd_range"))


def cross_distance_counts(candidates: DataFrame) -> DataFrame:
    """chrom, n_dist: how many pairs of sites of different methods there are."""
    n = candidates.groupBy("chrom", "method").agg(F.count("*").alias("n"))
    return n.groupBy("chrom").agg(((F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))) / 2).cast("long").alias("n_dist"))


def testable(candidates: DataFrame) -> DataFrame:
    """chrom of those where at least two methods have sites."""
    return candidates.groupBy("chrom").agg(F.countDistinct("method").alias("k")).where("k >= 2").select("chrom")


def axis_mismatch(universe: DataFrame, candidates: DataFrame) -> DataFrame:
    """method, max_chrom, universe_max of methods whose last chromosome is not the universe's."""
    top = universe.agg(F.max("chrom").alias("universe_max"))
    own = candidates.groupBy("method").agg(F.max("chrom").alias("max_chrom"))
    return own.join(F.broadcast(top)).where("max_chrom <> universe_max")


def significant(pvalues: DataFrame, alpha: float = 1.0) -> DataFrame:
    """chrom of those that pass on to the intersections."""
    return pvalues.where(F.col("p_value") <= alpha).select("chrom").distinct()
