"""The registered queries: each operator over whole test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..functions.hypergeom import overlap_pvalue, spread
from ..operators import calibrate, distances, islands, overlap, profiles, proximity, redundancy, resample, summary, uniformity
from ..operators.summary import chromosomes
from ..sources import reports
from . import bindings as b

#: Replicates and seed of the hash sampler in the queries that have SQL beside them, and of the index sampler in the test with many replicates.
REPLICATES, MANY, SEED, ALPHA, METHODS = 5, 200, 42, 0.05, 3


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def both(df: DataFrame, **arrays: str) -> DataFrame:
    """Arrays as comma-joined text."""
    return df.select(*(F.array_join(F.transform(c, lambda x: x.cast("string")), ",", "-").alias(c) if c in arrays else F.col(c) for c in df.columns))


def _l(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return b.universe_l(s, d), b.candidates_l(s, d)


def counts_l(s: SparkSession, d: str) -> DataFrame:
    u, c = b.rows_l(s, d)
    return overlap.overlap_counts(overlap.unit_flags(u, c), chromosomes(u, c), METHODS)


def overlap_test(s: SparkSession, d: str) -> DataFrame:
    """Do the methods meet more often than chance, chromosome by chromosome?"""
    u, c = _l(s, d)
    return overlap.overlap_test(u, c, METHODS)


def site_counts(s, d):
    return summary.site_counts(b.candidates_l(s, d))


def site_stats(s, d):
    return rounded(summary.site_stats(b.candidates_l(s, d)))


def range_stats(s, d):
    return rounded(summary.range_stats(summary.site_stats(b.candidates_l(s, d))))


def cross_distance_counts(s, d):
    return summary.cross_distance_counts(b.candidates_e(s, d))


def dense_counts(s, d):
    c = b.candidates_e(s, d)
    return summary.dense_counts(c, chromosomes(b.universe_e(s, d)), METHODS)


def testable_chromosomes(s, d):
    return summary.testable(b.candidates_e(s, d))


def axis_mismatch(s, d):
    u = b.universe_l(s, d).where("chrom < 10")
    return summary.axis_mismatch(u, b.candidates_l(s, d))


def _units(window):
    def query(s, d):
        u, c = b.rows_l(s, d)
        out = overlap.overlap_counts(overlap.unit_flags(u, c, window), chromosomes(u, c), METHODS)
        return out.select("chrom", "n_units", *(F.col("n_i")[m].alias(f"n_{m + 1}") for m in range(METHODS)), "k_obs")

    return query


def missing_from_universe(s, d):
    return overlap.missing_from_universe(b.universe_l_miss(s, d), b.candidates_l(s, d))


def in_universe(s, d):
    return overlap.in_universe(b.universe_l_miss(s, d), b.candidates_l(s, d)).groupBy("method", "chrom").agg(F.count("*").alias("n"))


def kway_overlap(s, d):
    return counts_l(s, d).select("chrom", "k_obs")


def expected_overlap(s, d):
    return rounded(counts_l(s, d).select("chrom", overlap.expected_overlap(F.col("n_i"), F.col("n_units")).alias("expected_k")))


def overlap_pvalue_k2(s, d):
    u, c = b.universe_l(s, d), b.candidates_l(s, d).where("method <= 2")
    n = overlap.overlap_counts(overlap.unit_flags(u, c), chromosomes(u, c), 2)
    return rounded(spread(n, "chrom").select("chrom", "k_obs", overlap_pvalue("n_i", "n_units", "k_obs").alias("p_value")))


def overlap_pvalue_k3(s, d):
    return rounded(spread(counts_l(s, d), "chrom").select("chrom", "k_obs", overlap_pvalue("n_i", "n_units", "k_obs").alias("p_value")))


def overlap_warnings(s, d):
    u, c = b.universe_l_miss(s, d), b.candidates_l(s, d)
    n = overlap.overlap_counts(overlap.unit_flags(u, c), chromosomes(u, c), METHODS)
    w = overlap.overlap_warnings(F.col("n_units"), F.col("missing_n"), F.col("missing_min"), METHODS)
    return n.select("chrom", F.array_join(w, "; ").alias("warnings"), F.exists("missing_n", lambda x: x > 0).alias("missing"))


def thin_clusters(s, d):
    return islands.thin_clusters(b.candidates_l(s, d), b.GAP, 10)


def pooled_islands(s, d):
    return islands.island_sizes(islands.pooled_islands(b.candidates_e(s, d), b.DISTANCE))


def proximity_pairs(s, d):
    return proximity.proximity_pairs(b.candidates_e(s, d), b.DISTANCE)


def _tuples(s, d, sizes=None):
    return proximity.proximity_tuples(b.candidates_e(s, d), b.DISTANCE, METHODS, sizes)


def proximity_tuples3(s, d):
    t = _tuples(s, d, (3,))
    return t.select("chrom", "subset", "size", *(F.col("positions")[m].alias(f"p{m + 1}") for m in range(3)))


def kway_sites(s, d):
    return proximity.kway_sites(_tuples(s, d, (3,)), METHODS)


def tuple_difference(s, d):
    """Pairs by the island join within 10,000 against pairs by the bin join within 12,000 whose first site is no multiple of 7."""
    t = _tuples(s, d, (2,))
    p = proximity.proximity_pairs(b.candidates_e(s, d), 12_000).where("pos_i % 7 <> 0")
    p = p.select("chrom", F.concat(F.lit("SEL_"), F.col("method_i").cast("string"), F.col("method_j").cast("string")).alias("subset"), F.array("pos_j", "pos_i").alias("positions"))
    return proximity.tuple_difference(t, p).groupBy("side").agg(F.count("*").alias("n"))


def _metrics(s, d):
    return uniformity.spatial_uniformity(b.universe_e(s, d))


def spatial_uniformity(s, d):
    return rounded(_metrics(s, d))


def uniformity_scores(s, d):
    return rounded(uniformity.percentile_scores(_metrics(s, d)))


def _rank(how):
    def query(s, d):
        return rounded(how(_metrics(s, d)).select("chrom", *(["composite_score"] if how is uniformity.rank_composite else ["ks_stat"]), "rank", "uniformity_class"))

    return query


def metric_classes(s, d):
    return rounded(uniformity.metric_classes(_metrics(s, d)))


def metrics_by_class(s, d):
    return uniformity.metrics_by_class(uniformity.metric_classes(_metrics(s, d)), "strong")


def metrics_not_close(s, d):
    return uniformity.metrics_by_class(uniformity.metric_classes(_metrics(s, d)), "close", exclude=True)


def containment(s, d):
    return redundancy.containment(b.candidates_r(s, d), METHODS)


def redundant_pairs(s, d):
    return redundancy.redundant_pairs(containment(s, d))


def redundant_pairs_global(s, d):
    return redundancy.redundant_pairs_global(containment(s, d))


def drop_redundant(s, d):
    c = b.candidates_r(s, d)
    kept, _ = redundancy.drop_redundant(c, redundant_pairs(s, d), METHODS)
    return kept.groupBy("method").agg(F.count("*").alias("n"))


def cross_distances(s, d):
    return distances.cross_distances(b.candidates_e(s, d)).groupBy("chrom").agg(F.count("*").alias("n"), F.sum("dist").alias("total"), F.min("dist").alias("least"), F.max("dist").alias("most"))


def nearest_distances(s, d):
    return distances.nearest_distances(b.candidates_e(s, d), 1, 10)


def _observed(s, d):
    return profiles.profile_of(b.candidates_e(s, d))


def distance_median(s, d):
    return rounded(distances.distance_medians(_observed(s, d)))


def _sampled(s, d, replicates=REPLICATES):
    n = b.candidates_e(s, d).groupBy("method", "chrom").agg(F.count("*").alias("n"))
    return resample.sample_without_replacement(b.universe_e(s, d), n, replicates, SEED)


def _expected(s, d):
    return profiles.expected_of(profiles.samples(_sampled(s, d), ("replicate", "chrom")))


def sample_without_replacement(s, d):
    return _sampled(s, d, 2)


def sample_uniform(s, d):
    n = b.candidates_e(s, d).groupBy("method", "chrom").agg(F.count("*").alias("n"))
    return resample.sample_uniform(b.universe_e(s, d), n, 2, SEED)


def sites_of_windows(s, d):
    u = b.universe_l(s, d)
    units = overlap.with_units(u, u, 10).select("chrom", F.col("unit").alias("pos")).distinct()
    n = b.candidates_l(s, d).groupBy("method", "chrom").agg(F.count("*").alias("n"))
    drawn = resample.sample_without_replacement(units, n, 1, SEED).withColumnRenamed("pos", "unit")
    return resample.sites_of_windows(u, drawn, 10, SEED)


def expected_profile(s, d):
    return rounded(_expected(s, d))


def profile_entropy(s, d):
    observed, _ = resample.held_against(b.universe_e(s, d), b.candidates_e(s, d), REPLICATES, SEED)
    return rounded(observed.select("chrom", "entropy"))


def distance_histogram(s, d):
    return rounded(resample.distance_histogram(b.universe_e(s, d), b.candidates_e(s, d), REPLICATES, SEED))


def _resampling(s, d, **options):
    u, c = b.universe_e(s, d), b.candidates_e(s, d)
    return resample.distance_test(u, c, chromosomes(u), options.pop("replicates", REPLICATES), SEED, **options)


def resampling_pvalue(s, d):
    return rounded(_resampling(s, d))


def resampling_pvalue_truncated(s, d):
    """The same test with medians cut to integers, as the report gives them."""
    return rounded(_resampling(s, d, truncate=True))


def resampling_pvalue_indices(s, d):
    """The same test by the index sampler."""
    return rounded(_resampling(s, d, sampler=resample.sample_indices))


def resampling_pvalue_many(s, d):
    """The same test with enough replicates for p = 0.005; too many rows for SQL, so a test holds it against rows of single distances."""
    return rounded(_resampling(s, d, replicates=MANY, sampler=resample.sample_indices))


def sample_indices(s, d):
    n = b.candidates_e(s, d).groupBy("method", "chrom").agg(F.count("*").alias("n"))
    return resample.sample_indices(b.universe_e(s, d), n, 2, SEED)


def _pvalues(s, d):
    u, c = _l(s, d)
    n = c.groupBy("method", "chrom").agg(F.count("*").alias("n"))
    return calibrate.calibrate_overlap(u, n, METHODS, 8, SEED)


def fp_rates(s, d):
    return rounded(calibrate.fp_rates(_pvalues(s, d), ALPHA))


def fwer(s, d):
    return rounded(calibrate.fwer(_pvalues(s, d), ALPHA).withColumn("expected", F.lit(calibrate.expected_fwer(10, ALPHA))))


def fp_summary(s, d):
    return rounded(calibrate.fp_summary(calibrate.fp_rates(_pvalues(s, d), ALPHA)))


def fp_top_chromosomes(s, d):
    return rounded(calibrate.fp_top_chromosomes(calibrate.fp_rates(_pvalues(s, d), 0.5)))


def universes(s, d):
    """The universe of L as (real, 0), its even sites as (half, 0), and the universe of L-miss as (half, 1)."""
    u, m = b.universe_l(s, d), b.universe_l_miss(s, d)
    tag = lambda t, name, k: t.select(F.lit(name).alias("scenario"), F.lit(k).alias("universe_id"), "chrom", "pos")
    return tag(u, "real", 0).unionByName(tag(u.where("pos % 2 = 0"), "half", 0)).unionByName(tag(m, "half", 1))


def calibrate_overlap_universes(s, d):
    """False-positive rates on universes of the caller's own."""
    n = b.candidates_l(s, d).groupBy("method", "chrom").agg(F.count("*").alias("n"))
    return rounded(calibrate.fp_rates(calibrate.calibrate_overlap(universes(s, d), n, METHODS, 4, SEED), 0.5))


def fp_summary_universes(s, d):
    """Deviation and error of the rates over several universes of a scenario."""
    n = b.candidates_l(s, d).groupBy("method", "chrom").agg(F.count("*").alias("n"))
    return rounded(calibrate.fp_summary(calibrate.fp_rates(calibrate.calibrate_overlap(universes(s, d), n, METHODS, 4, SEED), 0.5)))


def study_overlap(s, d):
    """The study of false positives as users call it, on the whole universe; as in ``fp_top_chromosomes`` alpha is 0.5."""
    from .. import workflow

    return rounded(workflow.study(*_l(s, d), replicates=20, alpha=0.5, seed=SEED).top)


def counts_table(s, d):
    """Sites of the universe and of each method, before and after thinning."""
    u, c = _l(s, d)
    names = c.select("method").distinct().withColumn("name", F.concat(F.lit("m"), F.col("method").cast("string")))
    return reports.counts_text(names, summary.site_counts(c), summary.site_counts(islands.thin_clusters(c, b.GAP, 10)), u)


def pvalue_text(s, d):
    """P-values as the distance report gives them."""
    return _resampling(s, d).select("chrom", scalars.pvalue_text(F.col("p_value"), 10_000).alias("p"))


def read_ragged(s, d):
    """Files with blank rows, chromosomes below 1 and thousands commas."""
    from ..sources.sites import read_sites, scratch

    u = b.universe_l(s, d)
    line = F.when(F.col("pos") % 5 == 0, ",").when(F.col("pos") % 7 == 0, F.concat_ws(",", F.lit("0"), F.col("pos").cast("string")))
    u = u.select(F.coalesce(line, F.concat(F.col("chrom").cast("string"), F.lit(',"'), F.format_number("pos", 0), F.lit('"'))).alias("chr,pos"))
    path = f"{scratch(s)}/ragged.csv"
    u.write.csv(path, sep="\x01", quote="", header=True)
    return read_sites(s, path).groupBy("chrom").agg(F.count("*").alias("n"), F.sum("pos").alias("total"))


def calibrate_overlap_windows(s, d):
    """With windows of ten positions and a test of the caller's own: the share of the windows hit by all methods."""
    def share(units, drawn, methods):
        keys = [*calibrate.KEYS, "chrom"]
        hit = drawn.groupBy(*keys, "pos").agg(F.countDistinct("method").alias("k")).groupBy(*keys).agg(F.avg((F.col("k") == methods).cast("double")).alias("p_value"))
        return hit

    n = b.candidates_l(s, d).groupBy("method", "chrom").agg(F.count("*").alias("n"))
    return rounded(calibrate.calibrate_overlap(b.universe_l(s, d), n, METHODS, 2, SEED, 10, share))


def calibrate_distance(s, d):
    u, c = b.universe_e(s, d), b.candidates_e(s, d)
    tag = lambda t, k: t.select(F.lit("real").alias("scenario"), F.lit(k).alias("universe_id"), "chrom", "pos")
    n = c.groupBy("method", "chrom").agg(F.count("*").alias("n"))
    return rounded(calibrate.fp_rates(calibrate.calibrate_distance(tag(u, 0).unionByName(tag(u.where("pos % 3 > 0"), 1)), n, 3, 4, SEED), 0.5))


def _uneven(m):
    return uniformity.metrics_by_class(uniformity.metric_classes(m), "close", exclude=True)


def report_overlap(s, d):
    u, c = _l(s, d)
    m = uniformity.spatial_uniformity(u)
    counts, totals = summary.dense_counts(c, chromosomes(u), METHODS), summary.chromosome_totals(u)
    return rounded(reports.overlap_report(overlap.overlap_test(u, c, METHODS), counts, totals, uniformity.rank_composite(m), METHODS, _uneven(m)))


def report_distance(s, d):
    u, c = b.universe_e(s, d), b.candidates_e(s, d)
    m = _metrics(s, d)
    counts, totals = summary.dense_counts(c, chromosomes(u), METHODS), summary.chromosome_totals(u)
    return rounded(reports.distance_report(_resampling(s, d, truncate=True), counts, totals, uniformity.rank_composite(m), METHODS, _uneven(m)))


def report_intersections_wide(s, d):
    return reports.intersections_wide(_tuples(s, d), proximity.subsets_of(METHODS), METHODS, b.DISTANCE)


def one_chromosome_tuples(s, d):
    """Tuples of one chromosome; the filter reaches the scan."""
    return proximity.proximity_tuples(summary.one_chromosome(b.candidates_e(s, d), 7), b.DISTANCE, METHODS, (2,)).select("chrom", "subset", F.col("positions")[0].alias("p1"), F.col("positions")[1].alias("p2"))


def _files(s, d):
    """The sites of L as text files, one folder for each layout of columns."""
    from ..sources.sites import scratch

    u = resample.kept(b.universe_l(s, d)).select(F.col("chrom").cast("string").alias("c"), F.col("pos").cast("string").alias("p"), F.format_number("pos", 0).alias("q"), F.col("pos"))
    x = F.lit("x")
    lines = {
        "comma.csv": ("chr,pos,name", F.concat_ws(",", "c", F.concat(F.lit('"'), "q", F.lit('"')), x)), "semicolon.csv": ("chr;pos", F.concat_ws(";", "c", "q")), "plain.map": (None, F.concat_ws("\t", "c", x, F.lit("0.5"), "p")),
        "first.tped": ("first line", F.concat_ws(" ", "c", x, F.lit("0"), "p", F.lit("A"))), "two.txt": ("CHR POS", F.concat_ws("  ", "c", "q")), "three.hapflk": ("rs chr pos", F.concat_ws(" ", x, "c", "p")),
        "last.norm": ("id pos crit", F.concat_ws("\t", x, "p", (F.col("pos") % 3 - 1).cast("string"))),
    }
    root = scratch(s)
    for name, (header, line) in lines.items():
        out = u.select(line.alias(header or "line")).write
        (out.csv(f"{root}/{name}", sep="\x01", quote="", header=True) if header else out.text(f"{root}/{name}"))
    return root, list(lines)


def read_layouts(s, d):
    """Sites written in every layout and read again."""
    from ..sources.sites import read_sites

    root, names = _files(s, d)
    rows = None
    for name in names:
        own = read_sites(s, f"{root}/{name}").groupBy("chrom").agg(F.count("*").alias("n"), F.sum("pos").alias("total")).withColumn("layout", F.lit(name))
        rows = own if rows is None else rows.unionByName(own)
    return rows


def load_files(s, d):
    """A universe and three candidate files of different layouts as two tables."""
    from ..sources.sites import load_sites

    root, _ = _files(s, d)
    _, c, names = load_sites(s, f"{root}/plain.map", [f"{root}/{x}" for x in ("comma.csv", "last.norm", "three.hapflk")])
    return summary.site_counts(c).join(names, "method")


def report_text(s, d):
    """The overlap report as it is written, read back from its file."""
    from ..sources.sites import scratch

    u, c = _l(s, d)
    m = uniformity.spatial_uniformity(u)
    report = reports.overlap_report(overlap.overlap_test(u, c, METHODS), summary.dense_counts(c, chromosomes(u), METHODS), summary.chromosome_totals(u), uniformity.rank_composite(m), METHODS, _uneven(m))
    path = scratch(s)
    reports.write_tsv(reports.overlap_text(report, METHODS), path)
    return s.read.csv(path, sep="\t", header=True).select("CHR", "TOTALS", "Nc", "SNPs1", "n1", "kobs", "Pr", "Uclasf")


def significant_tuples(s, d):
    """Tuples of the chromosomes that the distance test leaves at p <= 0.5."""
    gate = resample.kept(summary.significant(_resampling(s, d), 0.5))
    c = b.candidates_e(s, d).join(gate, "chrom", "left_semi")
    return proximity.proximity_tuples(c, b.DISTANCE, METHODS, (3,)).groupBy("chrom").agg(F.count("*").alias("n"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        site_counts, site_stats, range_stats, cross_distance_counts, dense_counts, testable_chromosomes, axis_mismatch, missing_from_universe, in_universe, kway_overlap,
        expected_overlap, overlap_pvalue_k2, overlap_pvalue_k3, overlap_warnings, thin_clusters, proximity_pairs, proximity_tuples3, kway_sites, tuple_difference,
        spatial_uniformity, uniformity_scores, metric_classes, metrics_by_class, metrics_not_close, containment, redundant_pairs, redundant_pairs_global, drop_redundant, cross_distances,
        nearest_distances, distance_median, sample_without_replacement, sample_uniform, sites_of_windows, expected_profile, profile_entropy, distance_histogram,
        resampling_pvalue, resampling_pvalue_truncated, resampling_pvalue_indices, resampling_pvalue_many, sample_indices, fp_rates, fwer, fp_summary, fp_top_chromosomes, calibrate_distance, calibrate_overlap_universes, calibrate_overlap_windows, fp_summary_universes, study_overlap, counts_table, pvalue_text, read_ragged, read_layouts, load_files, report_text, one_chromosome_tuples, report_overlap, report_distance,
        report_intersections_wide, significant_tuples,
    )
} | {
    "overlap_units_w1": _units(1), "overlap_units_w10": _units(10), "islands": pooled_islands, "rank_composite": _rank(uniformity.rank_composite),
    "rank_multivariate": _rank(uniformity.rank_multivariate), "rank_terciles": _rank(uniformity.rank_terciles),
}
