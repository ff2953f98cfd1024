"""Methods that find nearly the same sites as another."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RATIO, INCLUSION, LEAST_SITES = 0.75, 0.95, 5


def containment(candidates: DataFrame, methods: int) -> DataFrame:
    """method_i, method_j (i < j), chrom, n_i, n_j, shared: how many sites of the smaller set the larger one has.

    One self-join on (chrom, pos), where a key has at most as many rows as there
    are methods; pairs without common sites come from the grid of counts.
    """
    sites = candidates.select("method", "chrom", "pos").distinct()
    n = sites.groupBy("chrom", "method").agg(F.count("*").alias("n"))
    chroms = sites.select("chrom").distinct()
    pairs = chroms.select("chrom", F.explode(F.array(*(F.struct(F.lit(i).alias("method_i"), F.lit(j).alias("method_j")) for i in range(1, methods) for j in range(i + 1, methods + 1)))).alias("p"))
    pairs = pairs.select("chrom", "p.method_i", "p.method_j")
    a, b = (sites.select("chrom", "pos", F.col("method").alias(f"method_{c}")) for c in "ij")
    both = a.join(b, ["chrom", "pos"]).where("method_i < method_j").groupBy("method_i", "method_j", "chrom").agg(F.count("*").alias("shared"))
    for c in "ij":
        pairs = pairs.join(n.select("chrom", F.col("method").alias(f"method_{c}"), F.col("n").alias(f"n_{c}")), ["chrom", f"method_{c}"], "left")
    pairs = pairs.join(both, ["method_i", "method_j", "chrom"], "left")
    return pairs.select("method_i", "method_j", "chrom", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_i", "n_j", "shared")))


def _close(ratio: float, inclusion: float):
    small, large = F.least("n_i", "n_j"), F.greatest("n_i", "n_j")
    return (small >= ratio * large) & (F.col("shared") >= inclusion * small) & (small > 0)


def redundant_pairs(contained: DataFrame, ratio: float = RATIO, inclusion: float = INCLUSION, least: int = LEAST_SITES) -> DataFrame:
    """method_i, method_j, usable, redundant: redundant if close on every chromosome with enough sites, and there is one."""
    usable = F.greatest("n_i", "n_j") >= least
    return contained.groupBy("method_i", "method_j").agg(
        F.count_if(usable).alias("usable"), (F.coalesce(F.bool_and(F.when(usable, _close(ratio, inclusion))), F.lit(False))).alias("redundant")
    )


def redundant_pairs_global(contained: DataFrame, ratio: float = RATIO, inclusion: float = INCLUSION) -> DataFrame:
    """The same test on totals over all chromosomes; inclusion 1 asks for full containment."""
    total = contained.groupBy("method_i", "method_j").agg(*(F.sum(c).alias(c) for c in ("n_i", "n_j", "shared")))
    return total.withColumn("redundant", _close(ratio, inclusion))


def drop_redundant(candidates: DataFrame, pairs: DataFrame, methods: int) -> tuple[DataFrame, list[tuple[int, int]]]:
    """The candidates without redundant methods, and (kept, dropped) pairs.

    Walks the pairs in order (at most methods squared flags) and drops the method
    with fewer sites, the later one at equal numbers. At least two must remain.
    """
    totals = {r["method"]: r["n"] for r in candidates.groupBy("method").agg(F.count("*").alias("n")).collect()}
    gone: list[tuple[int, int]] = []
    for r in pairs.where("redundant").orderBy("method_i", "method_j").select("method_i", "method_j").collect():
        i, j = r["method_i"], r["method_j"]
        if not {i, j} & {d for _, d in gone}:
            gone.append((j, i) if totals.get(i, 0) < totals.get(j, 0) else (i, j))
    if methods - len(gone) < 2:
        raise ValueError("fewer than two methods remain")
    return candidates.where(~F.col("method").isin([d for _, d in gone])) if gone else candidates, gone
