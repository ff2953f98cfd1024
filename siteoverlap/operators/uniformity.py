"""How evenly sites cover each chromosome: statistics, scores, ranking.

All statistics are closed forms over the rank of a distinct position. A rank is that
within the bin plus the number of positions in the bins before, so a chromosome is
spread over as many tasks as it has bins, and only its bins are put in order.
Undefined values are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Metrics of the composite score and of the classes, in report order.
METRICS = ("ks_stat", "cvm_stat", "cv_counts")
LEAST_SITES, BIN_TARGET, BINS_LOW, BINS_HIGH = 10, 8, 20, 200


def spatial_uniformity(universe: DataFrame, bins: int | None = None) -> DataFrame:
    """chrom, n_raw, n_distinct, range_bp, bins_used, ks_stat, cvm_stat, chi2_stat, cv_counts against a uniform cover of [min, max].

    Fewer than 10 rows: all statistics null. A single position: ks 1, the rest null.
    """
    own = universe.groupBy("chrom", "pos").agg(F.count("*").alias("times"))
    size = own.groupBy("chrom").agg(F.count("*").alias("n"), F.sum("times").alias("raw"), F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    b = F.lit(bins) if bins else F.least(F.lit(BINS_HIGH), F.greatest(F.lit(BINS_LOW), F.floor(F.col("n") / BIN_TARGET)))
    size = size.withColumns({"span": F.col("hi") - F.col("lo"), "b": b.cast("long")}).drop("hi")
    rows = own.join(size, "chrom").withColumn("bin", F.floor((F.col("pos") - F.col("lo")) * F.col("b") / (F.col("span") + 1)))
    x, n = F.when(F.col("span") > 0, (F.col("pos") - F.col("lo")) / F.col("span")), F.col("n")
    rows = rows.select("chrom", "bin", "n", "raw", "span", "b", x.alias("x"), F.row_number().over(Window.partitionBy("chrom", "bin").orderBy("pos")).alias("r"))
    u = (2 * F.col("r") - 1) / (2 * n) - F.col("x")
    per_bin = rows.groupBy("chrom", "bin").agg(
        F.count("*").alias("c"), F.max(F.col("r") / n - F.col("x")).alias("over"), F.max(F.col("x") - (F.col("r") - 1) / n).alias("under"), F.sum(u).alias("u"), F.sum(u * u).alias("u2"),
        *(F.first(c).alias(c) for c in ("n", "raw", "span", "b")),
    )
    before = F.coalesce(F.sum("c").over(Window.partitionBy("chrom").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) / n
    off = F.col("off")
    out = per_bin.withColumn("off", before).groupBy("chrom").agg(
        F.max(F.greatest(F.col("over") + off, F.col("under") - off)).alias("ks"), F.sum(F.col("u2") + 2 * off * F.col("u") + F.col("c") * off * off).alias("cvm"),
        F.sum(F.col("c") * F.col("c")).cast("double").alias("c2"), *(F.first(c).alias(c) for c in ("n", "raw", "span", "b")),
    )
    enough, spread, mean = F.col("raw") >= LEAST_SITES, F.col("span") > 0, F.col("n") / F.col("b")
    ok = enough & spread
    return out.select(
        "chrom", F.col("raw").alias("n_raw"), F.col("n").alias("n_distinct"), F.col("span").alias("range_bp"), F.when(ok, F.col("b")).cast("int").alias("bins_used"),
        F.when(ok, F.col("ks")).when(enough, 1.0).alias("ks_stat"), F.when(ok, 1 / (12 * F.col("n")) + F.col("cvm")).alias("cvm_stat"),
        F.when(ok, F.col("c2") / mean - F.col("n")).alias("chi2_stat"), F.when(ok, F.sqrt(F.greatest(F.col("c2") / F.col("b") - mean * mean, F.lit(0.0))) / mean).alias("cv_counts"),
    )


def long_metrics(metrics: DataFrame) -> DataFrame:
    """chrom, metric, value; one row a chromosome and metric."""
    pairs = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS))
    return metrics.select("chrom", F.inline(pairs))


def percentile_scores(metrics: DataFrame) -> DataFrame:
    """chrom, metric, value, pct_score: tie-averaged rank over (n - 1); a metric with fewer than two values has none."""
    known = long_metrics(metrics).where("value is not null")
    of = Window.partitionBy("metric")
    n, ties = F.count("*").over(of), F.count("*").over(Window.partitionBy("metric", "value"))
    rank = F.rank().over(of.orderBy("value"))
    return known.withColumns({"n": n, "pct_score": (rank - 1 + (ties - 1) / 2) / (n - 1)}).where("n >= 2").drop("n")


def composite_scores(scores: DataFrame, how: str = "median") -> DataFrame:
    """chrom, composite_score: median or mean of the available scores."""
    value = F.percentile("pct_score", F.lit(0.5)) if how == "median" else F.avg("pct_score")
    return scores.groupBy("chrom").agg(value.alias("composite_score"))


def by_cuts(value: Column, low: Column, high: Column) -> Column:
    return F.when(value.isNull(), "insufficient_data").when(value <= low, "close").when(value >= high, "strong").otherwise("medium")


def ranked(rows: DataFrame, value: str) -> DataFrame:
    """Adds rank by a value, nulls last, then by chromosome; one row a chromosome, so one partition is enough."""
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.col(value).asc_nulls_last(), "chrom")))


def rank_composite(metrics: DataFrame, how: str = "median") -> DataFrame:
    """The metrics with composite_score, rank and class by the quartiles of the score."""
    rows = metrics.join(composite_scores(percentile_scores(metrics), how), "chrom", "left")
    cut = rows.agg(F.percentile("composite_score", F.array(F.lit(0.25), F.lit(0.75))).alias("cut"))
    rows = rows.join(F.broadcast(cut)).withColumn("uniformity_class", by_cuts(F.col("composite_score"), F.col("cut")[0], F.col("cut")[1]))
    return ranked(rows.drop("cut"), "composite_score")


def metric_cuts(metrics: DataFrame, low: float = 0.25, high: float = 0.75) -> DataFrame:
    """metric, low, high: its percentiles."""
    cut = F.percentile("value", F.array(F.lit(low), F.lit(high)))
    return long_metrics(metrics).where("value is not null").groupBy("metric").agg(cut.alias("cut")).select("metric", F.col("cut")[0].alias("low"), F.col("cut")[1].alias("high"))


def metric_classes(metrics: DataFrame) -> DataFrame:
    """chrom, metric, value, metric_class by each metric's own quartiles."""
    rows = long_metrics(metrics).join(F.broadcast(metric_cuts(metrics)), "metric", "left")
    return rows.select("chrom", "metric", "value", by_cuts(F.col("value"), F.col("low"), F.col("high")).alias("metric_class"))


def rank_multivariate(metrics: DataFrame, key: str = "ks_stat", require: int = 2) -> DataFrame:
    """Rank by one metric; close or strong if at least ``require`` metrics are."""
    votes = metric_classes(metrics).groupBy("chrom").agg(
        F.count("value").alias("known"), F.count_if(F.col("metric_class") == "close").alias("close"), F.count_if(F.col("metric_class") == "strong").alias("strong")
    )
    label = F.when(F.col("known") == 0, "insufficient_data").when(F.col("close") >= require, "close").when(F.col("strong") >= require, "strong").otherwise("medium")
    return ranked(metrics.join(votes, "chrom").withColumn("uniformity_class", label).drop("known", "close", "strong"), key)


def rank_terciles(metrics: DataFrame, key: str = "ks_stat") -> DataFrame:
    """Rank and class by the 33rd and 66th percentile of one metric."""
    cut = metrics.agg(F.percentile(key, F.array(F.lit(0.33), F.lit(0.66))).alias("cut"))
    rows = metrics.join(F.broadcast(cut)).withColumn("uniformity_class", by_cuts(F.col(key), F.col("cut")[0], F.col("cut")[1])).drop("cut")
    return ranked(rows, key)


def metrics_by_class(classes: DataFrame, label: str, exclude: bool = False) -> DataFrame:
    """chrom, metrics: the metrics of that class, or with ``exclude`` those of any other, in report order, comma-joined."""
    fits = F.col("metric_class") != label if exclude else F.col("metric_class") == label
    had = classes.groupBy("chrom").agg(F.collect_set(F.when(fits, F.col("metric"))).alias("had"))
    order = F.array(*(F.lit(m) for m in METRICS))
    return had.select("chrom", F.concat_ws(",", F.filter(order, lambda m: F.array_contains("had", m))).alias("metrics"))
