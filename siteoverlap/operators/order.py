"""Places in order within groups, without a task that orders a whole group.

A place is that within a bin of values plus the rows of the bins before. Bins have
equal width and a bounded number of rows on average, so only a group's bins are put
in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a bin, on average.
BIN_ROWS = 1 << 16


def binned(rows: DataFrame, by: tuple[str, ...], value: str, bin_rows: int = BIN_ROWS) -> DataFrame:
    """The rows with ``bin``: integer values in bins of equal width, as many as the group's rows ask for."""
    size = rows.groupBy(*by).agg(F.min(value).alias("bin low"), F.max(value).alias("bin high"), F.ceil(F.count("*") / bin_rows).alias("bins"))
    at = F.floor((F.col(value) - F.col("bin low")) * F.col("bins") / (F.col("bin high") - F.col("bin low") + 1))
    return rows.join(size, list(by)).withColumn("bin", at).select(*rows.columns, "bin")


def places(rows: DataFrame, by: tuple[str, ...], value: str, bin_rows: int = BIN_ROWS) -> DataFrame:
    """The rows with ``place`` (from 0) in order of an integer value; equal values have a place each."""
    own = binned(rows, by, value, bin_rows)
    before = Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    before = own.groupBy(*by, "bin").agg(F.count("*").alias("n")).select(*by, "bin", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    own = own.withColumn("within", F.row_number().over(Window.partitionBy(*by, "bin").orderBy(value)))
    return own.join(before, [*by, "bin"]).select(*rows.columns, (F.col("before") + F.col("within") - 1).alias("place"))


def percentiles(placed: DataFrame, by: tuple[str, ...], value: str, shares: tuple[float, ...]) -> DataFrame:
    """by, q (array): interpolated percentiles of a value that grows with ``place`` (from 0); only the rows beside them are looked at."""
    n = placed.groupBy(*by).agg(F.count("*").alias("rows"))
    at = [F.lit(s) * (F.col("rows") - 1) for s in shares]
    near = placed.join(n, list(by)).where(F.array_contains(F.array(*(f(x).cast("long") for x in at for f in (F.floor, F.ceil))), F.col("place")))
    v = F.col(value).cast("double")
    low, high = ([F.max(F.when(F.col("place") == f(x), v)) for x in at] for f in (F.floor, F.ceil))
    part = [F.max(x - F.floor(x)) for x in at]
    return near.groupBy(*by).agg(F.array(*(a + (b - a) * p for a, b, p in zip(low, high, part, strict=True))).alias("q"))
