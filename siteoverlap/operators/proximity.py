"""Site pairs and tuples within a distance, for every subset of methods.

A tuple (one site of each method of a subset) qualifies if its sites, sorted,
follow each other in steps of at most the distance. So tuples grow in order of
position: each is extended by the sites at most the distance behind its last one, of
methods it does not have, by an equi-join on bins. All subsets share this one chain
of joins, and every row on the way is a qualifying tuple itself.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def subset_name(methods: tuple[int, ...], k: int) -> str:
    """SEL_123; with ten or more methods SEL_1_2_3, which stays unambiguous."""
    return "SEL_" + ("_" if k >= 10 else "").join(map(str, methods))


def subsets_of(methods: int, sizes: tuple[int, ...] | None = None) -> list[tuple[int, ...]]:
    """All subsets of these sizes (2 to all), smaller ones first."""
    return [x for size in sizes or range(2, methods + 1) for x in combinations(range(1, methods + 1), size)]


def proximity_pairs(candidates: DataFrame, distance: int) -> DataFrame:
    """method_i, method_j, chrom, pos_i, pos_j (i < j) of distinct sites at most ``distance`` apart, by a join on bins of distance + 1."""
    sites = candidates.select("method", "chrom", "pos").distinct().withColumn("bin", F.floor(F.col("pos") / (distance + 1)))
    a = sites.select(F.col("method").alias("method_i"), "chrom", F.col("pos").alias("pos_i"), "bin")
    b = sites.select(F.col("method").alias("method_j"), "chrom", F.col("pos").alias("pos_j"), F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)).alias("bin"))
    near = (F.col("method_i") < F.col("method_j")) & (F.abs(F.col("pos_i") - F.col("pos_j")) <= distance)
    return a.join(b, ["chrom", "bin"]).where(near).select("method_i", "method_j", "chrom", "pos_i", "pos_j")


def grown_tuples(candidates: DataFrame, distance: int, most: int) -> list[DataFrame]:
    """The qualifying tuples of 1, 2, ..., ``most`` sites: chrom, mask (bit i - 1: method i), sites (method, pos, in order of position), last_pos, last_method.

    Sites at one position come in order of their methods, so each tuple arises once.
    """
    sites = candidates.select("method", "chrom", "pos").distinct()
    bit, width = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("method") - 1), distance + 1
    own = F.struct("method", "pos")
    tuples = [sites.select("chrom", bit.alias("mask"), F.array(own).alias("sites"), F.col("pos").alias("last_pos"), F.col("method").alias("last_method"))]
    # a site is offered to the tuples that end in its bin and in the one before
    offered = sites.select("chrom", F.explode(F.array(F.floor(F.col("pos") / width) - 1, F.floor(F.col("pos") / width))).alias("bin"), "method", "pos", bit.alias("bit"))
    behind = (F.col("pos") - F.col("last_pos") <= distance) & ((F.col("pos") > F.col("last_pos")) | ((F.col("pos") == F.col("last_pos")) & (F.col("method") > F.col("last_method"))))
    for _ in range(most - 1):
        joined = tuples[-1].withColumn("bin", F.floor(F.col("last_pos") / width)).join(offered, ["chrom", "bin"]).where(behind & (F.col("mask").bitwiseAND(F.col("bit")) == 0))
        tuples.append(joined.select("chrom", F.col("mask").bitwiseOR(F.col("bit")).alias("mask"), F.concat("sites", F.array(own)).alias("sites"), F.col("pos").alias("last_pos"), F.col("method").alias("last_method")))
    return tuples


def proximity_tuples(candidates: DataFrame, distance: int, methods: int, sizes: tuple[int, ...] | None = None) -> DataFrame:
    """chrom, subset, size, positions (in method order) of all qualifying tuples of the subsets of these sizes (2 to all)."""
    sizes = sorted(sizes or range(2, methods + 1))
    tuples, out = grown_tuples(candidates, distance, sizes[-1]), None
    for size in sizes:
        line = F.array_sort("sites")
        name = F.concat(F.lit("SEL_"), F.array_join(F.transform(line, lambda x: x["method"].cast("string")), "_" if methods >= 10 else ""))
        rows = tuples[size - 1].select("chrom", name.alias("subset"), F.lit(size).alias("size"), F.transform(line, lambda x: x["pos"]).alias("positions"))
        out = rows if out is None else out.unionByName(rows)
    return out


def kway_sites(tuples: DataFrame, methods: int) -> DataFrame:
    """chrom, pos of all sites in a tuple of all methods."""
    return tuples.where(F.col("size") == methods).select("chrom", F.explode("positions").alias("pos")).distinct()


def tuple_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """side, chrom, subset, positions: tuples of one result only, the order inside a tuple set aside."""
    x, y = (t.select("chrom", "subset", F.array_sort("positions").alias("positions")).distinct() for t in (a, b))
    return x.exceptAll(y).withColumn("side", F.lit("left")).unionByName(y.exceptAll(x).withColumn("side", F.lit("right")))
