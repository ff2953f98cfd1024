"""Distances between sites of different methods, and their profile."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import BIN_ROWS, binned, percentiles, places
from .profiles import arrow

BINS_LOW, BINS_HIGH = 30, 500
#: Sites that are put in order together, on average.
BIN_SITES = 4096


def cross_distances(candidates: DataFrame, keys: tuple[str, ...] = ("chrom",)) -> DataFrame:
    """keys, dist: one row for each pair of sites of different methods; repeated sites count each time.

    Each site meets the sites of higher methods on its chromosome: the size is the
    operator's own output (``cross_distance_counts``), and thinning keeps it small.
    Spark splits skewed chromosomes of this join.
    """
    a = candidates.select(*keys, F.col("method").alias("mi"), F.col("pos").alias("pi"))
    b = candidates.select(*keys, F.col("method").alias("mj"), F.col("pos").alias("pj"))
    return a.join(b, list(keys)).where("mi < mj").select(*keys, F.abs(F.col("pi") - F.col("pj")).alias("dist"))


def profile(distances: DataFrame, keys: tuple[str, ...] = ("chrom",), bin_rows: int = BIN_ROWS) -> DataFrame:
    """keys, rnk, dist: distances by rank within their keys. ``profiles.profile_of`` ranks without rows to sort."""
    return places(distances.select(*keys, "dist"), keys, "dist", bin_rows).select(*keys, (F.col("place") + 1).alias("rnk"), "dist")


def paired(sites: DataFrame, by: tuple[str, ...], last: int) -> DataFrame:
    """by, bin, other (bin), dist of each site (method, chrom, pos, bin) with those of the ``last`` sites behind it that are of other methods."""
    ahead = Window.partitionBy(*by).orderBy("pos", "method").rowsBetween(1, last)
    pairs = sites.select("*", F.collect_list(F.struct("method", "pos", "bin")).over(ahead).alias("others")).select("*", F.explode("others").alias("to"))
    return pairs.where(F.col("to.method") != F.col("method")).select("chrom", "bin", F.col("to.bin").alias("other"), (F.col("to.pos") - F.col("pos")).alias("dist"))


def nearest_distances(candidates: DataFrame, first: int = 1, last: int = 10, bin_sites: int = BIN_SITES) -> DataFrame:
    """chrom, rnk, dist: the first to last smallest distances of each chromosome.

    Each site meets only the ``last`` sites behind it. Of two sites further apart in
    order, each site between them is of another method than one of the two, which
    makes as many pairs that are no wider. Sites are put in order within bins of equal
    width; the ``last`` sites at each end of a bin are enough for pairs across bins.
    """
    sites = binned(candidates.select("method", "chrom", "pos"), ("chrom",), "pos", bin_sites)
    order = Window.partitionBy("chrom", "bin").orderBy("pos", "method")
    ends = sites.withColumns({"up": F.row_number().over(order), "n": F.count("*").over(Window.partitionBy("chrom", "bin"))})
    ends = ends.where((F.col("up") <= last) | (F.col("up") > F.col("n") - last)).select("method", "chrom", "pos", "bin")
    near = paired(sites, ("chrom", "bin"), last).unionByName(paired(ends, ("chrom",), last).where("bin <> other"))
    best = Window.partitionBy("chrom", "bin").orderBy("dist")
    near = near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= last)
    ranked = near.select("chrom", F.row_number().over(Window.partitionBy("chrom").orderBy("dist")).alias("rnk"), "dist")
    return ranked.where((F.col("rnk") <= last) & (F.col("rnk") >= first))


def distance_medians(ranked: DataFrame, value: str = "dist", keys: tuple[str, ...] = ("chrom",), truncate: bool = False) -> DataFrame:
    """keys, median: interpolated, read from the middle ranks of a profile."""
    n = ranked.groupBy(*keys).agg(F.count("*").alias("n"))
    middle = ranked.join(n, list(keys)).where((F.col("rnk") >= F.floor((F.col("n") + 1) / 2)) & (F.col("rnk") <= F.floor(F.col("n") / 2) + 1))
    median = F.avg(F.col(value).cast("double"))
    return middle.groupBy(*keys).agg((F.floor(median).cast("double") if truncate else median).alias("median"))


def relative_entropy(observed: DataFrame, expected: DataFrame, keys: tuple[str, ...] = ("chrom",), on: tuple[str, ...] = ("chrom",)) -> DataFrame:
    """keys, entropy of two profiles (dist by rank, avg_dist by rank), both normalised to sum 1.

    0 where a profile has fewer than two ranks or no distance; profiles of unequal
    length are an error. With the sum of the expected profile known (a row for each of
    ``on``), one join and one aggregate do: sum of P ln P - P ln Q from sums of p.
    """
    sums = expected.groupBy(*on).agg(F.sum("avg_dist").alias("sq"), F.count("*").alias("length"))
    q = expected.join(sums, list(on)).select(*on, "rnk", "sq", "length", F.ln(F.greatest(F.col("avg_dist") / F.when(F.col("sq") > 0, F.col("sq")), F.lit(1e-15))).alias("lq"))
    both = observed.select(*keys, "rnk", F.col("dist").cast("double").alias("p")).join(q, [*on, "rnk"], "left")
    p = F.col("p")
    sums = both.groupBy(*keys).agg(
        F.sum("p").alias("sp"), F.sum(F.when(p > 0, p * F.ln("p")).otherwise(0.0)).alias("plp"), F.sum(F.when(p > 0, p * F.col("lq")).otherwise(0.0)).alias("plq"),
        F.count("*").alias("n"), F.max("length").alias("length"), F.max("sq").alias("sq"),
    )
    ok = (F.col("n") >= 2) & (F.col("sp") > 0) & (F.col("sq") > 0)
    entropy = F.when(ok, (F.col("plp") - F.col("plq")) / F.col("sp") - F.ln("sp")).otherwise(0.0)
    same = F.col("n") == F.col("length")
    return sums.select(*keys, F.when(F.coalesce(same, F.lit(False)), entropy).otherwise(F.raise_error(F.lit("profiles of different length")).cast("double")).alias("entropy"))


def bins_of(n: Column, span: Column, iqr: Column) -> Column:
    """Bins of n distances by their spread: 30 to 500."""
    width = F.when(span == 0, 1.0).otherwise(2 * F.when(iqr == 0, 1.0).otherwise(iqr) / F.pow(n, F.lit(1 / 3)))
    return F.when(span == 0, BINS_LOW).otherwise(F.least(F.lit(BINS_HIGH), F.greatest(F.lit(BINS_LOW), F.ceil(span / width)))).cast("long")


def distance_histogram(observed: DataFrame, expected: DataFrame) -> DataFrame:
    """chrom, series, bin, freq: shares of distances per bin; bins follow the spread of the expected profile (30 to 500) and span both series."""
    ends = expected.groupBy("chrom").agg(F.count("*").alias("n"), (F.max("avg_dist") - F.min("avg_dist")).alias("span"))
    e = ends.join(percentiles(expected.withColumn("place", F.col("rnk") - 1), ("chrom",), "avg_dist", (0.25, 0.75)), "chrom")
    e = e.select("chrom", bins_of(F.col("n"), F.col("span"), F.col("q")[1] - F.col("q")[0]).alias("nb"))
    rows = observed.select("chrom", F.lit("observed").alias("series"), F.col("dist").cast("double").alias("v")).unionByName(expected.select("chrom", F.lit("expected").alias("series"), F.col("avg_dist").alias("v")))
    ends = rows.groupBy("chrom").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    rows = rows.join(ends, "chrom").join(e, "chrom")
    b = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.floor((F.col("v") - F.col("lo")) * F.col("nb") / (F.col("hi") - F.col("lo"))), F.col("nb") - 1))
    counted = rows.withColumn("bin", b.cast("long")).groupBy("chrom", "series", "bin").agg(F.count("*").alias("c"))
    return counted.withColumn("freq", F.col("c") / F.sum("c").over(Window.partitionBy("chrom", "series"))).drop("c")


def histograms_of(profiles: DataFrame) -> DataFrame:
    """The same columns from a row (chrom, observed, expected) for each chromosome, its sorted distances as arrays: counted where the row is, without rows of distances."""
    e, n = F.col("expected"), F.size("expected")
    at = [F.lit(s) * (n - 1) for s in (0.25, 0.75)]
    low, high = ([F.get(e, f(x).cast("int")) for x in at] for f in (F.floor, F.ceil))
    q = [a + (b - a) * (x - F.floor(x)) for a, b, x in zip(low, high, at, strict=True)]
    ends = [(F.get(c, F.lit(0)), F.get(c, F.size(c) - 1)) for c in ("observed", "expected")]
    nb = bins_of(n, ends[1][1] - ends[1][0], q[1] - q[0])
    rows = profiles.select("chrom", "observed", "expected", F.least(*(x for x, _ in ends)).alias("lo"), F.greatest(*(x for _, x in ends)).alias("hi"), nb.alias("nb"))
    own, schema = arrow(rows.select("chrom"), "series string, bin long, freq double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lo, hi, nb = (batch.column(c).to_numpy() for c in ("lo", "hi", "nb"))
            for series in ("observed", "expected"):
                v, n = batch.column(series).flatten().to_numpy(), np.diff(batch.column(series).offsets.to_numpy())
                row = np.repeat(np.arange(len(n)), n)
                span = (hi - lo)[row]
                b = np.where(span == 0, 0, np.minimum(np.floor((v - lo[row]) * nb[row] / np.where(span == 0, 1, span)), nb[row] - 1)).astype(np.int64)
                first = np.flatnonzero(np.append(True, (np.diff(row) != 0) | (np.diff(b) != 0))) if len(b) else np.zeros(0, np.int64)
                freq = np.diff(np.append(first, len(b))) / n[row[first]]
                yield pa.RecordBatch.from_arrays([batch.column("chrom").take(pa.array(row[first])), pa.array([series] * len(first), pa.string()), pa.array(b[first]), pa.array(freq)], schema=own)

    return rows.mapInArrow(run, schema)
