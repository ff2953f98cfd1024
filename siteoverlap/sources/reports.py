"""Reports: the tables a user reads, and their sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import distance_label, probability_text, pvalue_text
from ..operators.proximity import kway_sites, subset_name


def _uniform(ranking: DataFrame, not_uniform: DataFrame | None) -> DataFrame:
    out = ranking.select("chrom", "composite_score", "rank", "uniformity_class")
    if not_uniform is None:
        return out.withColumn("not_uniform", F.lit(""))
    return out.join(not_uniform.select("chrom", F.col("metrics").alias("not_uniform")), "chrom", "left")


def _sites(counts: DataFrame, totals: DataFrame, methods: int) -> DataFrame:
    """chrom, total_sites (of the universe), sites_1, sites_2, ..."""
    snps = counts.groupBy("chrom").pivot("method", list(range(1, methods + 1))).agg(F.first("n"))
    snps = snps.select("chrom", *(F.coalesce(str(m), F.lit(0)).alias(f"sites_{m}") for m in range(1, methods + 1)))
    return snps.join(totals.select("chrom", F.col("total").alias("total_sites")), "chrom", "full").fillna(0)


def overlap_report(test: DataFrame, counts: DataFrame, totals: DataFrame, ranking: DataFrame, methods: int, not_uniform: DataFrame | None = None) -> DataFrame:
    """One row a chromosome: universe sites, units, per method candidate sites and units, k_obs, expected_k, p_value, and how even the universe is."""
    rows = test.select("chrom", "n_units", *(F.col("n_i")[m - 1].alias(f"units_{m}") for m in range(1, methods + 1)), "k_obs", "expected_k", "p_value")
    rows = rows.join(_sites(counts, totals, methods), "chrom", "left").fillna(0, ["total_sites", *(f"sites_{m}" for m in range(1, methods + 1))])
    return rows.join(_uniform(ranking, not_uniform), "chrom", "left")


def distance_report(test: DataFrame, counts: DataFrame, totals: DataFrame, ranking: DataFrame, methods: int, not_uniform: DataFrame | None = None) -> DataFrame:
    """One row a chromosome: universe sites, sites by method, entropy, p_value, truncated medians, and how even the universe is."""
    rows = test.select("chrom", "entropy", "p_value", F.floor("o_median").cast("long").alias("o_q2"), F.floor("e_median").cast("long").alias("e_q2"))
    rows = rows.join(_sites(counts, totals, methods), "chrom", "left").fillna(0, ["total_sites", *(f"sites_{m}" for m in range(1, methods + 1))])
    return rows.join(_uniform(ranking, not_uniform), "chrom", "left")


def intersections_wide(tuples: DataFrame, subsets: list[tuple[int, ...]], methods: int, distance: int) -> DataFrame:
    """chrom, row, distance (as 1E4), a column for each subset with its tuples as text, and the sites of the tuples of all methods; columns of a chromosome end at different rows."""
    text = F.concat_ws(",", F.transform("positions", lambda x: x.cast("string")))
    sites = kway_sites(tuples, methods).select("chrom", F.lit("intersec_sites").alias("subset"), F.array("pos").alias("positions"))
    order = Window.partitionBy("chrom", "subset").orderBy("positions")
    rows = tuples.select("chrom", "subset", "positions").unionByName(sites).withColumn("row", F.row_number().over(order)).withColumn("text", text)
    wide = rows.groupBy("chrom", "row").pivot("subset", [*(subset_name(s, methods) for s in subsets), "intersec_sites"]).agg(F.first("text"))
    return wide.withColumn("distance", distance_label(F.lit(distance)))


def counts_text(names: DataFrame, counts_read: DataFrame, counts: DataFrame, universe: DataFrame) -> DataFrame:
    """The table above a report: a row for the universe (number 0) and each method, with its sites, those read, and a note where thinning left fewer. counts: as of ``summary.site_counts``, numbered like names."""
    total = lambda t, name: t.where("chrom = 0").select("method", F.col("n").alias(name))
    rows = names.join(total(counts, "sites"), "method", "left").join(total(counts_read, "sites_read"), "method", "left").fillna(0, ["sites", "sites_read"])
    everything = universe.agg(F.count("*").alias("sites")).select(F.lit(0).alias("method"), F.lit("universe").alias("name"), "sites", F.col("sites").alias("sites_read"))
    note = F.when(F.col("sites") != F.col("sites_read"), F.concat(F.lit("after grouping from "), F.col("sites_read").cast("string"))).otherwise("")
    return everything.unionByName(rows.select("method", "name", "sites", "sites_read")).withColumn("note", note)


def overlap_text(report: DataFrame, methods: int) -> DataFrame:
    """The overlap report as it is written: its titles, probabilities as text, in order of the chromosomes."""
    by_method = [c for m in range(1, methods + 1) for c in (F.col(f"sites_{m}").alias(f"SNPs{m}"), F.col(f"units_{m}").alias(f"n{m}"))]
    return report.orderBy("chrom").select(
        F.col("chrom").alias("CHR"), F.col("total_sites").alias("TOTALS"), F.col("n_units").alias("Nc"), *by_method, F.col("k_obs").alias("kobs"), F.col("expected_k").alias("E_k_null"),
        probability_text(F.col("p_value")).alias("Pr"), F.round("composite_score", 2).alias("URank"), F.col("uniformity_class").alias("Uclasf"), F.col("not_uniform").alias("notU"),
    )


def distance_text(report: DataFrame, methods: int, replicates: int) -> DataFrame:
    """The distance report as it is written; the entropy of an untested chromosome is -1."""
    return report.orderBy("chrom").select(
        F.col("chrom").alias("CHR"), F.col("total_sites").alias("TOTALS"), *(F.col(f"sites_{m}").alias(f"SEL-{m}") for m in range(1, methods + 1)),
        F.round(F.coalesce("entropy", F.lit(-1.0)), 4).alias("KL"), pvalue_text(F.col("p_value"), replicates).alias("Pr"), F.col("o_q2").alias("oQ2"), F.col("e_q2").alias("eQ2"),
        F.round("composite_score", 2).alias("URank"), F.col("uniformity_class").alias("Uclasf"), F.col("not_uniform").alias("notU"),
    )


def write_tsv(report: DataFrame, path: str) -> None:
    """Tab-separated text with a header, in the order of the report (one row a chromosome or intersection row)."""
    report.write.csv(path, sep="\t", header=True)


def write_tuples(tuples: DataFrame, path: str) -> None:
    """The long table of tuples, a folder a chromosome, in order within each file; a chromosome with many tuples has several files."""
    tuples.repartitionByRange("chrom", "subset", "positions").sortWithinPartitions("chrom", "subset", "positions").write.partitionBy("chrom").parquet(path)
