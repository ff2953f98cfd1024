"""From files to reports in one call."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import calibrate, distances, overlap, profiles, proximity, redundancy, resample, summary, uniformity
from .operators.islands import thin_clusters
from .operators.summary import chromosomes, one_chromosome, only_numbered
from .sources import reports, sites


@dataclass
class Result:
    """Tables of one analysis; those of steps left out are None."""

    names: DataFrame
    counts_read: DataFrame
    counts: DataFrame
    dropped: list[tuple[int, int]]
    test: DataFrame | None = None
    report: DataFrame | None = None
    text: DataFrame | None = None
    tuples: DataFrame | None = None
    intersections: DataFrame | None = None
    methods: int = field(default=0)
    counts_text: DataFrame | None = None
    histogram: DataFrame | None = None
    same_files: bool = False


@dataclass
class Study:
    """Tables of a study of false positives."""

    pvalues: DataFrame
    rates: DataFrame
    fwer: DataFrame
    summary: DataFrame
    top: DataFrame
    expected_fwer: float


def ranked(metrics: DataFrame, ranking: str = "composite", metric: str = "ks_stat", how: str = "median") -> DataFrame:
    """The metrics with composite_score, rank and uniformity_class: by the composite score ("composite", of median or mean), by one metric and its terciles ("terciles"), or by one metric and the classes of all ("multivariate")."""
    if ranking not in ("composite", "terciles", "multivariate"):
        raise ValueError(f"no ranking {ranking}")
    composite = uniformity.rank_composite(metrics, how)
    if ranking == "composite":
        return composite
    own = uniformity.rank_terciles(metrics, metric) if ranking == "terciles" else uniformity.rank_multivariate(metrics, metric)
    return own.join(composite.select("chrom", "composite_score"), "chrom")


def same_chromosomes(universe: DataFrame, candidates: DataFrame, names: DataFrame) -> None:
    """An error where the last chromosome of a method is not the universe's: all must number them alike."""
    wrong = summary.axis_mismatch(universe, candidates).join(names, "method").orderBy("method").collect()  # a row a method
    if wrong:
        raise ValueError("chromosomes do not match the universe's: " + ", ".join(f"{r['name']} ends at {r['max_chrom']}, not {r['universe_max']}" for r in wrong))


def analyse(
    universe: DataFrame, candidates: DataFrame, names: DataFrame, *, test: str | None = "overlap", chrom: int | None = None, gap: int = 10_000, thin_from: int | None = None, remove_redundant: bool = True,
    window: int = 1, replicates: int = 1000, seed: int = 1, uniform: bool = False, truncate: bool = True, alpha: float = 0.05, distance: int = 10_000, intersections: bool = True,
    check_axis: bool = True, whole_genome: bool = False, ranking: str = "composite", metric: str = "ks_stat", how: str = "median",
) -> Result:
    """One chromosome or all, thinning, redundant methods, the test ("overlap", "distance" or None), its report, and the tuples of the chromosomes with p <= alpha (all without a test).

    ``thin_from`` is the number of sites from which a (method, chromosome) is
    thinned; ``uniform`` draws the replicates of the distance test uniformly.
    ``check_axis`` asks that all methods end at the universe's last chromosome;
    ``whole_genome`` compares methods over all chromosomes together before one is
    dropped; ``ranking``, ``metric`` and ``how`` are those of ``ranked``.
    """
    universe, read = (one_chromosome(only_numbered(t), chrom) for t in (universe, candidates))
    if check_axis:
        same_chromosomes(universe, read, names)
    sites_ = thin_clusters(read, gap, thin_from)
    k = names.count()  # a row a file
    same = names.select(F.upper("name")).distinct().count() == 1 < k
    dropped: list[tuple[int, int]] = []
    if remove_redundant:
        sites_, dropped = redundancy.drop_redundant(sites_, (redundancy.redundant_pairs_global if whole_genome else redundancy.redundant_pairs)(redundancy.containment(sites_, k)), k)
    gone = [d for _, d in dropped]
    left, _, _ = renumbered(read, names, gone)
    sites_, names, k = renumbered(sites_, names, gone)
    out = Result(names, summary.site_counts(read), summary.site_counts(sites_), dropped, methods=k, same_files=same)
    out.counts_text = reports.counts_text(names, summary.site_counts(left), out.counts, universe)
    if test:
        axis = chromosomes(universe, sites_)
        counts, totals = summary.dense_counts(sites_, axis, k), summary.chromosome_totals(universe)
        metrics = uniformity.spatial_uniformity(universe)
        order, uneven = ranked(metrics, ranking, metric, how), uniformity.metrics_by_class(uniformity.metric_classes(metrics), "close", exclude=True)
        if test == "overlap":
            out.test = overlap.overlap_test(universe, sites_, k, window)
            out.report = reports.overlap_report(out.test, counts, totals, order, k, uneven)
            out.text = reports.overlap_text(out.report, k)
        else:
            sampler = resample.sample_uniform if uniform else resample.sample_indices
            observed, expected, nulls = resample.distance_tables(universe, sites_, replicates, seed, sampler, truncate)
            out.test = resample.kept(resample.resampling_pvalue(observed, expected, nulls, axis, replicates, truncate))
            out.histogram = distances.distance_histogram(profiles.profile_of(sites_), expected)
            out.report = reports.distance_report(out.test, counts, totals, order, k, uneven)
            out.text = reports.distance_text(out.report, k, replicates)
    if intersections:
        gated = sites_ if out.test is None else sites_.join(summary.significant(out.test, alpha), "chrom", "left_semi")
        out.tuples = proximity.proximity_tuples(gated, distance, k)
        subsets = proximity.subsets_of(k)
        out.intersections = reports.intersections_wide(out.tuples, subsets, k, distance)
    return out


def renumbered(candidates: DataFrame, names: DataFrame, gone: list[int]) -> tuple[DataFrame, DataFrame, int]:
    """Methods numbered from 1 again after some were dropped (one row a method)."""
    left = sorted(r["method"] for r in names.select("method").collect() if r["method"] not in gone)
    if not gone:
        return candidates, names, len(left)
    new = F.create_map(*(F.lit(x) for k, m in enumerate(left, 1) for x in (m, k)))
    renamed = (t.where(F.col("method").isin(left)).withColumn("method", F.element_at(new, F.col("method"))) for t in (candidates, names))
    return (*renamed, len(left))


def study(
    universe: DataFrame, candidates: DataFrame, *, test: str = "overlap", replicates: int = 100, null_replicates: int = 1000, window: int = 1, alpha: float = 0.05, seed: int = 1, universes: DataFrame | None = None, chrom: int | None = None, out: str | None = None,
) -> Study:
    """How often a test finds something where candidates of the same sizes are drawn at random: p-values of all replicates, rates, rates of any finding in a replicate, their summary over universes and the chromosomes with the highest rates.

    The candidates count alone; they are drawn from the universe, or from each of
    ``universes`` (scenario, universe_id, chrom, pos). With ``out`` the tables are
    written below that folder.
    """
    universe, candidates = (one_chromosome(only_numbered(t), chrom) for t in (universe, candidates))
    n = candidates.groupBy("method", "chrom").agg(F.count("*").alias("n"))
    drawn_from = universe if universes is None else one_chromosome(only_numbered(universes), chrom)
    if test == "overlap":
        methods = candidates.agg(F.max("method")).first()[0] or 0
        p = calibrate.calibrate_overlap(drawn_from, n, methods, replicates, seed, window, sampler=resample.sample_indices)
    else:
        p = calibrate.calibrate_distance(drawn_from, n, replicates, null_replicates, seed, resample.sample_indices)
    p = resample.kept(p)
    rates = resample.kept(calibrate.fp_rates(p, alpha))
    tested = universe.agg(F.countDistinct("chrom")).first()[0]
    result = Study(p, rates, calibrate.fwer(p, alpha), calibrate.fp_summary(rates), calibrate.fp_top_chromosomes(rates), calibrate.expected_fwer(tested, alpha))
    if out:
        result.pvalues.write.parquet(f"{out}/pvalues")
        for name, order in (("rates", ["scenario", "universe_id", "chrom"]), ("fwer", ["scenario", "universe_id"]), ("summary", ["scenario"]), ("top", ["scenario", "rank"])):
            reports.write_tsv(getattr(result, name).orderBy(*order), f"{out}/{name}")
    return result


def run_study(spark: SparkSession, universe: str, candidates: list[str], out: str | None = None, **options) -> Study:
    """``study`` of files."""
    sites_, read, _ = sites.load_sites(spark, universe, candidates)
    return study(sites_, read, out=out, **options)


def run(spark: SparkSession, universe: str, candidates: list[str], out: str | None = None, **options) -> Result:
    """``analyse`` of files; with ``out`` the counts, the report, the histogram, the tuples and the wide intersections are written below that folder (with ``_SAMEFILES`` behind their names where all candidate files have one name, as a control)."""
    result = analyse(*sites.load_sites(spark, universe, candidates), **options)
    if out:
        same = "_SAMEFILES" if result.same_files else ""
        reports.write_tsv(result.counts_text.orderBy("method"), f"{out}/counts{same}")
        if result.histogram is not None:
            reports.write_tsv(result.histogram.orderBy("chrom", "series", "bin"), f"{out}/histogram{same}")
        if result.text is not None:
            reports.write_tsv(result.text, f"{out}/report{same}")
        if result.tuples is not None:
            reports.write_tuples(result.tuples, f"{out}/tuples{same}")
            reports.write_tsv(result.intersections.orderBy("chrom", "row"), f"{out}/intersections{same}")
    return result
