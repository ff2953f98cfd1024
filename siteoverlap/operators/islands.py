"""Gaps and islands: thinning of clusters, pooled islands.

Sites in one stretch of gap + 1 positions belong to one island anyway. So sites are
first combined by (group, stretch), where Spark aggregates before the shuffle, and
only the stretches are put in order: a group has at most range / gap of them, however
many sites it has. With small gaps that is no bound, so stretches are put in order
within bins, and bins hand on their last position and how many islands they began.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .order import BIN_ROWS, binned


def stretch(gap: int):
    return F.floor(F.col("pos") / F.lit(gap + 1))


#: Gaps from which the stretches of a group are few enough for one task.
WIDE_GAP = 1000


def stretches(sites: DataFrame, gap: int, by: tuple[str, ...], bin_rows: int = BIN_ROWS) -> DataFrame:
    """by, stretch, first, last, n, island (from 0): a new island starts where the step from the site before exceeds the gap."""
    some = sites.groupBy(*by, stretch(gap).alias("stretch")).agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.count("*").alias("n"))
    if gap >= WIDE_GAP:
        return begun(some, gap, by, "stretch").drop("far")
    own = begun(binned(some, by, "stretch", bin_rows), gap, (*by, "bin"), "stretch")
    bins = own.groupBy(*by, "bin").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("far").alias("inside"))
    bins = begun(bins, gap, by, "bin")
    before = Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select(*by, "bin", (F.col("island") + F.coalesce(F.sum("inside").over(before), F.lit(0))).alias("before"))
    return own.join(bins, [*by, "bin"]).withColumn("island", F.col("island") + F.col("before")).drop("far", "bin", "before")


def begun(rows: DataFrame, gap: int, by: tuple[str, ...], order: str) -> DataFrame:
    """The rows (first, last) with far (1: more than the gap behind the row before) and island (how many such rows there are up to here)."""
    line = Window.partitionBy(*by).orderBy(order)
    far = F.coalesce((F.col("first") - F.lag("last").over(line) > gap).cast("long"), F.lit(0))
    return rows.withColumn("far", far).withColumn("island", F.sum("far").over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def with_islands(sites: DataFrame, gap: int, by: tuple[str, ...]) -> DataFrame:
    """The sites with their ``island``."""
    found = stretches(sites, gap, by).select(*by, "stretch", "island")
    return sites.withColumn("stretch", stretch(gap)).join(found, [*by, "stretch"]).select(*sites.columns, "island")


def thin_clusters(candidates: DataFrame, gap: int = 10_000, least: int | None = None) -> DataFrame:
    """In groups of at least ``least`` sites, keep the first and last site of each cluster; None switches it off.

    The universe is never thinned.
    """
    sites = candidates.select("method", "chrom", "pos")
    if least is None:
        return sites
    ends = stretches(sites, gap, ("method", "chrom")).groupBy("method", "chrom", "island").agg(F.min("first").alias("a"), F.max("last").alias("b"), F.sum("n").alias("n"))
    ends = ends.withColumn("total", F.sum("n").over(Window.partitionBy("method", "chrom")))
    thinned = ends.where(F.col("total") >= least).select("method", "chrom", F.explode(F.array_distinct(F.array("a", "b"))).alias("pos"))
    small = sites.groupBy("method", "chrom").agg(F.count("*").alias("n")).where(F.col("n") < least)
    return thinned.unionByName(sites.join(small, ["method", "chrom"], "left_semi"))


def pooled_islands(candidates: DataFrame, distance: int) -> DataFrame:
    """method, chrom, pos, island over the distinct sites of all methods; members of a tuple share an island."""
    return with_islands(candidates.select("method", "chrom", "pos").distinct(), distance, ("chrom",))


def island_sizes(islands: DataFrame) -> DataFrame:
    """chrom, island, sites, first_pos, last_pos; the largest tells how many tuples to expect."""
    return islands.groupBy("chrom", "island").agg(F.count("*").alias("sites"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))
