"""Universe and candidate tables from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Distance of the event bindings, in seconds; gap of the thinning of binding L.
DISTANCE, GAP = 10_000, 5


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return t.select((F.col("l_suppkey") % 10 + 1).cast("int").alias("chrom"), F.col("l_partkey").cast("long").alias("pos"), "l_quantity", "l_returnflag", "l_linestatus")


def rows_l(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Universe and candidates of binding L with repeated sites, for operators that group them by site anyway."""
    t = _lines(spark, sf_dir)
    method = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2).when(F.col("l_returnflag") == "R", 3)
    return t.select("chrom", "pos"), t.where("l_quantity > 45").select(method.alias("method"), "chrom", "pos").where("method is not null")


def universe_l(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows_l(spark, sf_dir)[0].distinct()


def candidates_l(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows_l(spark, sf_dir)[1].distinct()


def universe_l_miss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).where("l_linestatus = 'O' and l_quantity <= 30").select("chrom", "pos").distinct()


def candidates_r(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _lines(spark, sf_dir)
    q = F.col("l_quantity")
    of = F.array_compact(F.array(F.when(q > 40, 1), F.when(q > 39, 2), F.when((q > 40) & (F.col("l_returnflag") == "A"), 3)))
    return t.select(F.explode(of).alias("method"), "chrom", "pos").distinct()


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/events.parquet")
    second = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000)
    return t.select((F.col("user_id") + 1).cast("int").alias("chrom"), second.alias("pos"), "event_type")


def universe_e(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("chrom", "pos")


def candidates_e(spark: SparkSession, sf_dir: str) -> DataFrame:
    method = F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "purchase", 2).when(F.col("event_type") == "view", 3)
    return _events(spark, sf_dir).select(method.alias("method"), "chrom", "pos").where("method is not null").distinct()
