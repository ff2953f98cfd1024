"""Golden cases and properties of the site operators."""

import itertools
import os
import random
from fractions import Fraction
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F
from siteoverlap.functions import scalars
from siteoverlap.functions.hypergeom import cascade_tail
from siteoverlap.operators import calibrate, distances, islands, order, overlap, profiles, proximity, redundancy, resample, summary, uniformity
from siteoverlap.sources import reports, sites


def cands(spark, sets, chrom=1):
    return spark.createDataFrame([(m, chrom, p) for m, s in enumerate(sets, 1) for p in s], "method int, chrom int, pos long")


def uni(spark, pos, chrom=1):
    return spark.createDataFrame([(chrom, p) for p in pos], "chrom int, pos long")


@pytest.mark.parametrize(
    ("n", "total", "k", "p"),
    [
        ([5, 7], 20, 3, 0.20678534571723425), ([12, 15, 9], 60, 2, 0.06630600241434763), ([30, 40, 25, 33], 120, 2, 0.10858020053431605), ([60, 80], 200, 40, 5.545132329294632e-07),
        ([5, 5], 5, 5, 1.0), ([0, 4], 9, 0, 1.0), ([3, 4], 9, 4, 0.0), ([2, 3], 0, 0, 1.0), ([2, 3], 0, 1, 0.0), ([4], 9, 3, 1.0),
    ],
)
def test_cascade_golden(n, total, k, p):
    assert cascade_tail(n, total, k) == pytest.approx(p, rel=1e-9)
    assert cascade_tail(n[::-1], total, k) == pytest.approx(p, rel=1e-9)


def test_cascade_exact_and_errors():
    def exact(n, total, k):
        mass = {min(n): Fraction(1)}
        for x in sorted(n)[1:]:
            new: dict[int, Fraction] = {}
            for t, p in mass.items():
                for s in range(max(0, t + x - total), min(t, x) + 1):
                    new[s] = new.get(s, 0) + p * Fraction(comb(t, s) * comb(total - t, x - s), comb(total, x))
            mass = new
        return float(sum(p for s, p in mass.items() if s >= k))

    draw = random.Random(1)
    for _ in range(40):
        total = draw.randint(3, 30)
        n = [draw.randint(1, total) for _ in range(draw.randint(2, 4))]
        k = draw.randint(1, min(n))
        assert cascade_tail(n, total, k) == pytest.approx(exact(n, total, k), rel=1e-8, abs=1e-12)
    with pytest.raises(ValueError, match="do not fit"):
        cascade_tail([3, 10], 9, 1)


def test_distance_vector(spark):
    d = distances.cross_distances(cands(spark, [[1, 3, 7], [2, 4], [2, 3, 4, 7, 10]]))
    got = sorted(r["dist"] for r in d.collect())
    assert len(got) == 31 and sum(got) == 91 and got == sorted([0] * 4 + [1] * 8 + [2] * 3 + [3] * 6 + [4] * 2 + [5] * 3 + [6] * 2 + [7, 8, 9])
    assert distances.distance_medians(distances.profile(d)).first()["median"] == 3
    assert summary.cross_distance_counts(cands(spark, [[1, 3, 7], [2, 4], [2, 3, 4, 7, 10]])).first()["n_dist"] == 31


def test_tuples_golden(spark):
    c = cands(spark, [[1, 2, 3, 4, 5], [3, 4, 5, 6], [5, 6, 7, 8, 9, 10], [6], [7]])
    t = proximity.proximity_tuples(c, 1, 5).collect()
    n: dict[str, int] = {}
    for r in t:
        n[r["subset"][4:]] = n.get(r["subset"][4:], 0) + 1
    want = "12:9 13:3 14:1 23:6 24:2 25:1 34:3 35:3 45:1 123:13 124:4 125:1 134:4 135:1 145:1 234:7 235:5 245:2 345:4 1234:16 1235:8 1245:4 1345:5 2345:9 12345:20"
    assert n == {k: int(v) for k, v in (x.split(":") for x in want.split())}
    full = sorted(r["positions"] for r in t if r["size"] == 5)
    assert full[:3] == [[3, 4, 5, 6, 7], [4, 3, 5, 6, 7], [4, 4, 5, 6, 7]]
    assert {x for p in full for x in p} == {3, 4, 5, 6, 7, 8}
    assert proximity.subset_name((1, 12), 12) == "SEL_1_12"


@pytest.mark.parametrize("seed", range(3))
def test_pairs_by_bins_islands_and_brute_force(spark, seed):
    draw = random.Random(seed)
    sets = [sorted({draw.randint(-40, 200) for _ in range(25)}) for _ in range(3)]
    want = {(i + 1, j + 1, a, b) for i, j in itertools.combinations(range(3), 2) for a in sets[i] for b in sets[j] if abs(a - b) <= 7}
    c = cands(spark, sets)
    assert {tuple(r) for r in proximity.proximity_pairs(c, 7).select("method_i", "method_j", "pos_i", "pos_j").collect()} == want
    t = proximity.proximity_tuples(c, 7, 3)
    assert {(int(r["subset"][4]), int(r["subset"][5]), *r["positions"]) for r in t.where("size = 2").collect()} == want
    three = {x for x in itertools.product(*sets) if max(b - a for a, b in itertools.pairwise(sorted(x))) <= 7}
    assert {tuple(r["positions"]) for r in t.where("size = 3").collect()} == three
    assert proximity.tuple_difference(t, t).count() == 0


@pytest.mark.parametrize("k", [2, 3, 4, 5])
def test_tuples_equal_all_products(spark, k):
    draw = random.Random(k)
    sets = [sorted({draw.randint(-20, 60) for _ in range(9)}) for _ in range(k)]
    t = proximity.proximity_tuples(cands(spark, sets), 4, k)
    want = set()
    for size in range(2, k + 1):
        for subset in itertools.combinations(range(k), size):
            for x in itertools.product(*(sets[m] for m in subset)):
                if all(b - a <= 4 for a, b in itertools.pairwise(sorted(x))):
                    want.add(("SEL_" + "".join(str(m + 1) for m in subset), size, x))
    got = [(r["subset"], r["size"], tuple(r["positions"])) for r in t.collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_tuples_of_a_dense_stretch(spark):
    """One long island: what is joined on the way are qualifying tuples, not products of the island."""
    sets = [[30 * k + 10 * m for k in range(300)] for m in range(3)]
    levels = proximity.grown_tuples(cands(spark, sets), 10, 3)
    assert islands.pooled_islands(cands(spark, sets), 10).select("island").distinct().count() == 1
    assert [x.count() for x in levels] == [900, 899, 898]
    assert proximity.proximity_tuples(cands(spark, sets), 10, 3).count() == 899 + 898
    many = cands(spark, [[5]] * 11)
    assert proximity.proximity_tuples(many, 0, 11, (11,)).first()["subset"] == "SEL_1_2_3_4_5_6_7_8_9_10_11"


def test_profiles_by_blocks(spark):
    """Blocks of few ranks, with ties across their bounds, against sorted lists of all pairs."""
    draw = random.Random(8)
    groups = {1: [[draw.randint(0, 30) for _ in range(n)] for n in (12, 1, 7)], 2: [[5] * 20, [5] * 9], 3: [[draw.randint(0, 10**12) for _ in range(15)] for _ in range(2)], 4: [[1, 2, 3]], 5: [[1], [4]]}
    c = None
    for chrom, sets in groups.items():
        own = cands(spark, sets, chrom)
        c = own if c is None else c.union(own)
    want = {(chrom, k, d) for chrom, sets in groups.items() for k, d in enumerate(sorted(abs(a - b) for x, y in itertools.combinations(sets, 2) for a in x for b in y), 1)}
    for block in (7, 64, profiles.BLOCK):
        assert {tuple(r) for r in profiles.profile_of(c, block=block).collect()} == want
    assert {tuple(r) for r in distances.profile(distances.cross_distances(c)).collect()} == want


def test_blocks_equal_single_rows(spark):
    """Expected profile and summaries by blocks and chunks against the same from rows of single distances."""
    u = uni(spark, random.Random(1).sample(range(5_000), 200)).union(uni(spark, random.Random(2).sample(range(500), 90), 2))
    n = spark.createDataFrame([(1, 1, 9), (2, 1, 8), (3, 1, 2), (1, 2, 5), (2, 2, 4), (1, 3, 4)], "method int, chrom int, n long")
    drawn = resample.sample_indices(u, n, 20, 5)
    rows = resample.replicate_profiles(drawn)
    expected = resample.expected_profile(rows)
    want = {(r["chrom"], r["rnk"]): r["avg_dist"] for r in expected.collect()}
    held = {(r["chrom"], r["replicate"]): (r["entropy"], r["median"]) for r in resample.null_summaries(rows, expected).collect()}
    s = profiles.samples(drawn, ("replicate", "chrom"))
    for block, chunk in ((10, 3), (profiles.BLOCK, profiles.CHUNK)):
        blocks = profiles.expected_of(s, block=block, chunk=chunk)
        got = {(r["chrom"], r["rnk"]): r["avg_dist"] for r in blocks.collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
        summary_rows = {(r["chrom"], r["replicate"]): (r["entropy"], r["median"]) for r in profiles.summaries_of(s, expected, block=block, chunk=chunk).collect()}
        assert summary_rows.keys() == held.keys() and all(summary_rows[k] == pytest.approx(held[k], abs=1e-9) for k in held)
    for wrong in (expected.where("rnk < 20"), expected.where("rnk <= 10"), expected.union(expected.selectExpr("chrom", "rnk + 100", "avg_dist"))):
        with pytest.raises(Exception, match="different length"):
            profiles.summaries_of(s, wrong, block=10).collect()


def test_repeated_rows_in_the_distance_test(spark):
    """Repeated rows of the universe are sites of their own, which a sample may hold as often."""
    u = uni(spark, [10] * 3 + [20] * 2 + [30])
    for sampler in (resample.sample_without_replacement, resample.sample_indices):
        whole = sampler(u, spark.createDataFrame([(1, 1, 6)], "method int, chrom int, n long"), 2, 1, strict=True).collect()
        assert sorted((r["replicate"], r["pos"]) for r in whole) == [(k, p) for k in (1, 2) for p in (10, 10, 10, 20, 20, 30)]
        with pytest.raises(Exception, match="larger"):
            sampler(u, spark.createDataFrame([(1, 1, 7)], "method int, chrom int, n long"), 1, 1, strict=True).collect()
        some = sampler(u, spark.createDataFrame([(1, 1, 1)], "method int, chrom int, n long"), 600, 1).groupBy("pos").count().collect()
        share = {r["pos"]: r["count"] / 600 for r in some}
        assert all(abs(share[p] - x) < 0.09 for p, x in ((10, 1 / 2), (20, 1 / 3), (30, 1 / 6)))
    same = cands(spark, [[10, 10, 20], [10, 20, 20]])
    assert resample.distance_test(u, same, u.select("chrom").distinct(), 5, 1).first()["p_value"] > 0


def test_places_by_bins(spark):
    draw = random.Random(6)
    pos = [draw.choice([3, 5, draw.randint(0, 10**9)]) for _ in range(500)]
    got = [tuple(r) for r in resample.numbered(uni(spark, pos), (), 32).select("place", "pos").orderBy("place").collect()]
    assert got == list(enumerate(sorted(pos)))
    u = uni(spark, pos).union(uni(spark, [7], 2)).union(uni(spark, [1, 2], 3))
    got = {r["chrom"]: r["q"] for r in order.percentiles(order.places(u, ("chrom",), "pos", 32), ("chrom",), "pos", (0.25, 0.5, 0.9)).collect()}
    for chrom, x in ((1, pos), (2, [7]), (3, [1, 2])):
        assert got[chrom] == pytest.approx(np.quantile(x, [0.25, 0.5, 0.9]).tolist())


@pytest.mark.parametrize("gap", [0, 1, 3])
def test_islands_by_bins(spark, gap):
    draw = random.Random(gap)
    pos = sorted({draw.randint(0, 700) for _ in range(300)} | {5_000, 5_001, 90_000})
    got = {r["first"]: r["island"] for r in islands.stretches(uni(spark, pos).union(uni(spark, [3], 2)), gap, ("chrom",), 16).where("chrom = 1").collect()}
    number, want = 0, {}
    for k, p in enumerate(pos):
        number += k > 0 and p - pos[k - 1] > gap
        want[p] = number
    assert got and all(want[p] == i for p, i in got.items()) and max(got.values()) == number


def test_thinning_and_windows(spark):
    c = cands(spark, [[10, 15, 18, 40, 41, 90]])
    assert sorted(r["pos"] for r in islands.thin_clusters(c, 5, 3).collect()) == [10, 18, 40, 41, 90]
    assert islands.thin_clusters(c, 5, 7).count() == 6 and islands.thin_clusters(c, 5).count() == 6
    w = uni(spark, [100, 149, 150, 260, 99, 40]).select("pos", overlap.window_id(F.col("pos"), F.lit(100), 50).alias("w"))
    assert {r["pos"]: r["w"] for r in w.collect()} == {100: 0, 149: 0, 150: 1, 260: 3, 99: -1, 40: -2}


def test_entropy(spark):
    obs = spark.createDataFrame([(1, k, v) for k, v in enumerate([0, 1, 2, 5], 1)] + [(2, 1, 5)] + [(3, k, 0) for k in (1, 2)], "chrom int, rnk int, dist long")
    exp = spark.createDataFrame([(1, k, float(v)) for k, v in enumerate([1, 2, 3, 4], 1)] + [(2, 1, 5.0)] + [(3, k, 1.0) for k in (1, 2)], "chrom int, rnk int, avg_dist double")
    got = {r["chrom"]: r["entropy"] for r in distances.relative_entropy(obs, exp).collect()}
    assert got[1] == pytest.approx(0.1745985962885566) and got[2] == 0 and got[3] == 0
    for longer, shorter in ((obs, exp.where("rnk < 4")), (obs.where("rnk < 4"), exp)):
        with pytest.raises(Exception, match="different length"):
            distances.relative_entropy(longer, shorter).collect()


def test_uniformity_golden(spark):
    u = uni(spark, [k * k for k in range(1, 13)]).union(uni(spark, range(9), 2)).union(uni(spark, [5] * 11, 3))
    got = {r["chrom"]: r for r in uniformity.spatial_uniformity(u).collect()}
    r = got[1]
    assert (r["n_distinct"], r["range_bp"], r["bins_used"]) == (12, 143, 20)
    assert (r["ks_stat"], r["cvm_stat"], r["chi2_stat"], r["cv_counts"]) == pytest.approx((0.2552447552447552, 0.2776582391967007, 11.333333333333334, 0.9718253158075502))
    assert got[2]["ks_stat"] is None and (got[3]["ks_stat"], got[3]["cvm_stat"]) == (1.0, None)
    ranked = {r["chrom"]: r for r in uniformity.rank_composite(uniformity.spatial_uniformity(u)).collect()}
    assert ranked[2]["uniformity_class"] == "insufficient_data" and ranked[2]["rank"] == 3
    m = spark.createDataFrame([(k, float(v), None, None) for k, v in enumerate([3, 1, 1, 7, 5], 1)], "chrom int, ks_stat double, cvm_stat double, cv_counts double")
    assert [r["pct_score"] for r in uniformity.percentile_scores(m).orderBy("chrom").collect()] == [0.5, 0.125, 0.125, 1.0, 0.75]


def test_identity_control(spark):
    same = [3, 8, 20, 50]
    u, c = uni(spark, range(100)), cands(spark, [same, same])
    r = overlap.overlap_test(u, c, 2).first()
    assert (r["n_i"], r["k_obs"], r["missing"]) == ([4, 4], 4, False) and r["p_value"] < 1e-5
    assert proximity.proximity_pairs(c, 0).count() == 4
    kept, gone = redundancy.drop_redundant(cands(spark, [same * 2, same * 2, [1]]), redundancy.redundant_pairs(redundancy.containment(cands(spark, [same, same, [1]]), 3), least=3), 3)
    assert gone == [(1, 2)] and kept.select("method").distinct().count() == 2
    with pytest.raises(ValueError, match="fewer than two"):
        redundancy.drop_redundant(c, redundancy.redundant_pairs(redundancy.containment(c, 2), least=3), 2)


def test_missing_and_warnings(spark):
    u, c = uni(spark, [1, 2, 3]), cands(spark, [[1, 9], [2, 3]])
    r = overlap.overlap_test(u, c, 2).first()
    assert r["missing"] and r["warnings"] == ["very small universe", "method 1: 1 not in the universe, first 9"]
    assert [tuple(x) for x in overlap.missing_from_universe(u, c).collect()] == [(1, 1, 1, 9)]
    far = overlap.overlap_test(u, cands(spark, [[1], [2]], chrom=3), 2).collect()
    assert sorted((x["chrom"], x["n_units"], x["p_value"]) for x in far) == [(1, 3, 1.0), (2, 0, 1.0), (3, 0, 1.0)]


def test_samplers_agree_and_repeat(spark):
    u = uni(spark, random.Random(1).sample(range(100_000), 300))
    n = spark.createDataFrame([(1, 1, 6), (2, 1, 8)], "method int, chrom int, n long")
    drawn = resample.sample_without_replacement(u, n, 60, 1)
    assert drawn.distinct().count() == 60 * 14
    hashed = {r["rnk"]: r["avg_dist"] for r in resample.expected_profile(resample.replicate_profiles(drawn)).collect()}
    indices = resample.sample_indices(u, n, 400, 1)
    assert indices.distinct().count() == indices.count() == 400 * 14
    places = {r["rnk"]: r["avg_dist"] for r in resample.expected_profile(resample.replicate_profiles(indices)).collect()}
    assert hashed.keys() == places.keys() and all(abs(hashed[k] - places[k]) < 0.15 * max(places.values()) for k in hashed)
    most = spark.createDataFrame([(1, 1, 290), (2, 1, 300), (3, 1, 400)], "method int, chrom int, n long")
    assert {tuple(r) for r in resample.sample_indices(u, most, 2, 1).groupBy("replicate", "method").agg(F.countDistinct("pos"), F.count("*")).collect()} == {(k, m, x, x) for k in (1, 2) for m, x in ((1, 290), (2, 300), (3, 300))}
    many = spark.createDataFrame([(1, 1, 500)], "method int, chrom int, n long")
    assert resample.sample_without_replacement(u, many, 1, 1).count() == 300
    for sampler in (resample.sample_without_replacement, resample.sample_indices):
        with pytest.raises(Exception, match="larger"):
            sampler(u, many, 1, 1, strict=True).collect()
    ends = resample.sample_uniform(u, n, 3, 1).agg(F.min("pos"), F.max("pos"), F.count("*")).first()
    assert ends[2] == 42 and ends[0] >= 0 and ends[1] < 100_000


def test_calibration_near_alpha(spark):
    u = uni(spark, range(400)).union(uni(spark, range(300), 2))
    n = spark.createDataFrame([(m, c, 60) for m in (1, 2) for c in (1, 2)], "method int, chrom int, n long")
    p = calibrate.calibrate_overlap(u, n, 2, 60, 3)
    rate = calibrate.fp_rates(p, 0.2).where("universe_id is null and chrom is null").first()
    assert rate["n"] == 120 and 0.03 < rate["rate"] < 0.3
    assert 0 <= calibrate.fwer(p, 0.2).first()["fwer"] <= 1
    d = calibrate.calibrate_distance(u, spark.createDataFrame([(1, 1, 5), (2, 1, 5), (1, 2, 5)], "method int, chrom int, n long"), 10, 50, 1).collect()
    assert len(d) == 20 and all(1 / 51 <= r["p_value"] <= 1 for r in d) and all(r["p_value"] == 1 for r in d if r["chrom"] == 2)


def test_calibration_counts_empty_chromosomes(spark):
    u = uni(spark, range(50)).union(uni(spark, range(40), 2)).union(uni(spark, range(30), 5))
    n = spark.createDataFrame([(m, 1, 10) for m in (1, 2)], "method int, chrom int, n long")
    p = calibrate.calibrate_overlap(u, n, 2, 4, 3)
    assert sorted((r["replicate"], r["chrom"]) for r in p.collect()) == [(r, c) for r in range(1, 5) for c in range(1, 6)]
    assert all(r["p_value"] == 1 for r in p.collect() if r["chrom"] > 1)
    rates = {r["chrom"]: (r["n"], r["positives"]) for r in calibrate.fp_rates(p, 0.5).where("universe_id is null").collect()}
    assert rates[None][0] == 20 and all(rates[c] == (4, 0) for c in range(2, 6))
    summary_row = calibrate.fp_summary(calibrate.fp_rates(p, 0.5)).first()
    assert (summary_row["chrom_min"], summary_row["chrom_median"]) == (0, 0)
    assert calibrate.fp_top_chromosomes(calibrate.fp_rates(p, 0.5)).count() == 5
    none = calibrate.calibrate_overlap(u, n.where("chrom > 1"), 2, 4, 3)
    assert none.count() == 20 and none.where("p_value < 1").isEmpty()


def test_readers(spark, tmp_path):
    def write(name, text):
        (tmp_path / name).write_text(text)
        return f"file://{tmp_path}/{name}"

    got = lambda df: sorted(map(tuple, df.collect()))
    assert got(sites.read_sites(spark, write("a.csv", 'chr,pos,x\n1,"12,345",a\n\n,,\n3,7,b\n'))) == [(1, 12345), (3, 7)]
    assert got(sites.read_sites(spark, write("b.csv", "chr;pos\n2;10\n1;5\n0;9\n"))) == [(1, 5), (2, 10)]
    for name, text in (("c.csv", "chr,pos\n1,\n"), ("c2.csv", "chr,pos\n1,x\n"), ("c.norm", "id pos crit\na five 1\n"), ("c2.norm", "id pos crit\na 5 x\n"), ("c.txt", "chr pos\n1\n")):
        with pytest.raises(Exception, match="missing or wrong"):
            sites.read_sites(spark, write(name, text)).count()
    assert got(sites.read_sites(spark, write("d.map", "1 rs1 0.5 100\n2\trs2 0.1  1,200\n"))) == [(1, 100), (2, 1200)]
    assert got(sites.read_sites(spark, write("e.tped", "1 a 0 1\n1 b 0 2\n"))) == [(1, 2)]
    assert got(sites.read_sites(spark, write("e2.tped", "1 a 0 1\n1 b 0 2\n"), header=False)) == [(1, 1), (1, 2)]
    assert got(sites.read_sites(spark, write("f.txt", "CHR POS\n1 12345\n 2 34 \n\n"))) == [(1, 12345), (2, 34)]
    assert got(sites.read_sites(spark, write("g.hapflk", "id chr pos\nx 4 9\n"))) == [(4, 9)]
    assert got(sites.read_sites(spark, write("h.norm", "id pos crit\na 5 1\nb 6 0\nc 7 -1\nd 8 2\n"))) == [(1, 5), (1, 8)]
    u, c, names = sites.load_sites(spark, f"file://{tmp_path}/f.txt", [f"file://{tmp_path}/d.map", f"file://{tmp_path}/g.hapflk"])
    assert u.count() == 2 and got(c) == [(1, 1, 100), (1, 2, 1200), (2, 4, 9)] and got(names) == [(1, "d"), (2, "g")]


def test_report_sinks(spark, tmp_path):
    c = cands(spark, [[1, 2, 30], [2, 31]])
    t = proximity.proximity_tuples(c, 1, 2)
    wide = reports.intersections_wide(t, [(1, 2)], 2, 10_000)
    assert [(r["SEL_12"], r["intersec_sites"], r["distance"]) for r in wide.orderBy("row").collect()] == [("1,2", "1", "1E4"), ("2,2", "2", "1E4"), ("30,31", "30", "1E4"), (None, "31", "1E4")]
    reports.write_tuples(t, f"file://{tmp_path}/t")
    reports.write_tsv(wide, f"file://{tmp_path}/w")
    assert spark.read.parquet(f"file://{tmp_path}/t").count() == 3 and spark.read.csv(f"file://{tmp_path}/w", sep="\t", header=True).count() == 4


def test_scalars(spark):
    one = spark.createDataFrame([(0.0, 10000, "/x/y/set one.map.txt", " 1,234 ")], "p double, d long, f string, n string")
    r = one.select(
        scalars.pvalue_text(F.col("p"), 1000), scalars.probability_text(F.lit(2e-7)), scalars.probability_text(F.lit(0.5)), scalars.distance_label(F.col("d")), scalars.stem(F.col("f")), scalars.number(F.col("n"))
    ).first()
    assert tuple(r) == ("0.001", "2.000000e-07", "0.500000", "1E4", "set one.map", 1234)
    assert summary.axis_mismatch(uni(spark, [1], 3), cands(spark, [[1]])).count() == 1


@pytest.mark.parametrize("seed", range(4))
def test_thinning_and_islands_equal_plain_versions(spark, seed):
    draw = random.Random(seed)
    sets = [[draw.randint(-300, 300) for _ in range(draw.choice([3, 20, 60]))] for _ in range(3)]
    gap, least = draw.choice([0, 1, 5, 40]), draw.choice([1, 10, 100])
    want = []
    for m, s in enumerate(sets, 1):
        line = sorted(s)
        if len(line) < least:
            want += [(m, 1, p) for p in line]
            continue
        cluster = [line[0]]
        for p in [*line[1:], None]:
            if p is None or p - cluster[-1] > gap:
                want += [(m, 1, x) for x in sorted({cluster[0], cluster[-1]})]
                cluster = []
            cluster.append(p)
    assert sorted(map(tuple, islands.thin_clusters(cands(spark, sets), gap, least).collect())) == sorted(want)
    line, island, number = sorted({p for s in sets for p in s}), {}, 0
    for k, p in enumerate(line):
        number += k > 0 and p - line[k - 1] > gap
        island[p] = number
    got = islands.pooled_islands(cands(spark, sets), gap).collect()
    assert len(got) == sum(len(set(s)) for s in sets) and all(island[r["pos"]] == r["island"] for r in got)


def test_nearest_distances_equal_all_pairs(spark):
    draw = random.Random(4)
    sets = [[draw.randint(0, 90) for _ in range(30)] for _ in range(3)]
    want = sorted(abs(a - b) for i, j in itertools.combinations(range(3), 2) for a in sets[i] for b in sets[j])
    for size in (distances.BIN_SITES, 20):
        got = distances.nearest_distances(cands(spark, sets), 3, 25, size).orderBy("rnk").collect()
        assert [(r["rnk"], r["dist"]) for r in got] == list(enumerate(want[2:25], 3))
    ranked = distances.profile(distances.cross_distances(cands(spark, sets)), bin_rows=50).orderBy("rnk").collect()
    assert [(r["rnk"], r["dist"]) for r in ranked] == list(enumerate(want, 1))


def test_log_factorials_at_any_size():
    from math import lgamma

    from siteoverlap.functions.hypergeom import log_factorial

    for n in (0, 1, 5, 170, 255, 256, 257, 1000, 10**6, 10**12):
        assert float(log_factorial(n)) == pytest.approx(lgamma(n + 1), rel=1e-14, abs=1e-13)
    assert cascade_tail([1000, 900], 10**9, 1) == pytest.approx(1 - (1 - 1000 / 1e9) ** 900, rel=1e-6)


def test_cascade_bands():
    """Bands against the whole sum in exact arithmetic, far tails and large sets included."""

    def exact(n, total, k):
        n = sorted(n)
        mass = {n[0]: Fraction(1)}
        for x in n[1:]:
            new: dict[int, Fraction] = {}
            for t, p in mass.items():
                for s in range(max(k, t + x - total), min(t, x) + 1):
                    new[s] = new.get(s, 0) + p * Fraction(comb(t, s) * comb(total - t, x - s), comb(total, x))
            mass = new
        return float(sum(mass.values()))

    for n, total, k in (([150, 160], 900, 20), ([150, 160], 900, 140), ([150, 300, 200], 10**9, 2), ([140, 180, 130], 400, 3), ([200, 200, 199], 200, 150), ([130, 1000, 900], 1000, 120), ([150, 131, 140, 160], 260, 14), ([300, 300], 600, 290)):
        assert cascade_tail(n, total, k) == pytest.approx(exact(n, total, k), rel=1e-9)
    assert cascade_tail([200_000] * 3, 1_900_000, 2216) == pytest.approx(0.50353, abs=1e-5)
    assert cascade_tail([200_000] * 3, 1_900_000, 3000) == pytest.approx(2.28392e-58, rel=1e-5)
    assert cascade_tail([10**6] * 3, 10**7, 1) == 1 and cascade_tail([3, 200, 2], 300, 3) == 0


def test_calibration_of_several_universes(spark):
    def universe(scenario, number, pos):
        return uni(spark, pos).select(F.lit(scenario).alias("scenario"), F.lit(number).alias("universe_id"), "chrom", "pos")

    u = universe("a", 0, range(60)).unionByName(universe("a", 1, range(300))).unionByName(universe("b", 0, range(60)))
    n = spark.createDataFrame([(m, 1, 20) for m in (1, 2)], "method int, chrom int, n long")
    for sampler in (resample.sample_without_replacement, resample.sample_indices):
        p = {(r["scenario"], r["universe_id"], r["replicate"]): r["p_value"] for r in calibrate.calibrate_overlap(u, n, 2, 5, 3, sampler=sampler).collect()}
        assert len(p) == 15 and all(p["a", 0, k] == p["b", 0, k] for k in range(1, 6)) and any(p["a", 0, k] != p["a", 1, k] for k in range(1, 6))
        alone = calibrate.calibrate_overlap(u.where("universe_id = 0 and scenario = 'a'").drop("scenario", "universe_id"), n, 2, 5, 3, sampler=sampler)
        assert {r["replicate"]: r["p_value"] for r in alone.collect()} == {k: p["a", 0, k] for k in range(1, 6)}
    few = n.withColumn("n", F.lit(4).cast("long"))
    d = calibrate.calibrate_distance(u, few, 5, 10, 3).collect()
    assert len(d) == 15 and {r["universe_id"] for r in d} == {0, 1} and all(1 / 11 <= r["p_value"] <= 1 for r in d)

    def always(units, drawn, methods):
        """A test of the caller's own: p = 0 wherever anything was drawn."""
        return drawn.select(*calibrate.KEYS, "chrom").distinct().withColumn("p_value", F.lit(0.0))

    assert {r["p_value"] for r in calibrate.calibrate_overlap(u, n, 2, 2, 3, window=7, test=always).collect()} == {0.0}


def test_metrics_that_are_not_close(spark):
    rows = spark.createDataFrame([(1, "ks_stat", "close"), (1, "cvm_stat", "medium"), (1, "cv_counts", "strong"), (2, "ks_stat", "close"), (3, "cv_counts", "insufficient_data"), (3, "ks_stat", "strong")], "chrom int, metric string, metric_class string")
    got = {r["chrom"]: r["metrics"] for r in uniformity.metrics_by_class(rows, "close", exclude=True).collect()}
    assert got == {1: "cvm_stat,cv_counts", 2: "", 3: "ks_stat,cv_counts"}
    assert {r["chrom"]: r["metrics"] for r in uniformity.metrics_by_class(rows, "strong").collect()} == {1: "cv_counts", 2: "", 3: "ks_stat"}


def test_from_files_to_reports(spark, tmp_path):
    from siteoverlap import workflow

    draw = random.Random(2)
    everything = sorted(draw.sample(range(100_000), 400))
    (tmp_path / "all.map").write_text("".join(f"{c} s 0 {p}\n" for c in (1, 2) for p in everything))
    one = draw.sample(everything, 30)
    files = []
    for name, sites_ in (("a", one), ("b", one[:29] + [everything[0]]), ("c", draw.sample(everything, 25))):
        (tmp_path / f"{name}.txt").write_text("CHR POS\n" + "".join(f"{c} {p}\n" for c in (1, 2) for p in sites_))
        files.append(f"file://{tmp_path}/{name}.txt")
    for test in ("overlap", "distance"):
        r = workflow.run(spark, f"file://{tmp_path}/all.map", files, f"file://{tmp_path}/{test}", test=test, replicates=20, alpha=1.0, distance=500)
        assert r.dropped == [(1, 2)] and r.methods == 2 and sorted(map(tuple, r.names.collect())) == [(1, "a"), (2, "c")]
        text = [x.asDict() for x in spark.read.csv(f"file://{tmp_path}/{test}/report", sep="\t", header=True).collect()]
        assert [x["CHR"] for x in text] == ["1", "2"] and all(x["TOTALS"] == "400" for x in text)
        assert ("kobs" in text[0]) == (test == "overlap") and "." in text[0]["Pr"]
        assert r.intersections.columns == ["chrom", "row", "SEL_12", "intersec_sites", "distance"]
        assert spark.read.parquet(f"file://{tmp_path}/{test}/tuples").count() == r.tuples.count() > 0
        assert (r.histogram is not None) == (test == "distance") and not r.same_files
        above = [tuple(x) for x in r.counts_text.orderBy("method").collect()]
        assert above == [(0, "universe", 800, 800, ""), (1, "a", 60, 60, ""), (2, "c", 50, 50, "")]
    only = workflow.run(spark, f"file://{tmp_path}/all.map", files, test=None, chrom=2, remove_redundant=False)
    assert only.methods == 3 and {x["chrom"] for x in only.tuples.select("chrom").distinct().collect()} == {2} and only.report is None


def test_choices_of_the_workflow(spark, tmp_path):
    from siteoverlap import workflow

    draw = random.Random(4)
    everything = sorted(draw.sample(range(10_000), 300))
    u = uni(spark, everything).union(uni(spark, everything[::3], 2)).union(uni(spark, [k * k for k in range(40)], 3))
    sets = [draw.sample(everything, 40) for _ in range(3)]
    c = cands(spark, sets).union(cands(spark, [s[:5] for s in sets], 3))
    names = spark.createDataFrame([(1, "A"), (2, "a"), (3, "a")], "method int, name string")
    r = workflow.analyse(u, c, names, thin_from=10, gap=200, ranking="terciles", metric="cv_counts", whole_genome=True, intersections=False)
    assert r.same_files and "after grouping from 45" in {x["note"] for x in r.counts_text.collect()}
    want = {x["chrom"]: (x["rank"], x["uniformity_class"]) for x in uniformity.rank_terciles(uniformity.spatial_uniformity(u), "cv_counts").collect()}
    assert {x["chrom"]: (x["rank"], x["uniformity_class"]) for x in r.report.collect()} == want and all(x["composite_score"] is not None for x in r.report.collect())
    for ranking in ("composite", "multivariate"):
        assert workflow.ranked(uniformity.spatial_uniformity(u), ranking, how="mean").count() == 3
    with pytest.raises(ValueError, match="no ranking"):
        workflow.ranked(u, "x")
    with pytest.raises(ValueError, match="A ends at 1, not 3"):
        workflow.analyse(u, c.where("method > 1 or chrom = 1"), names)
    assert workflow.analyse(u, c.where("method > 1 or chrom = 1"), names, check_axis=False, remove_redundant=False).methods == 3


def test_study_from_files(spark, tmp_path):
    from siteoverlap import workflow

    draw = random.Random(3)
    everything = {k: sorted(draw.sample(range(5_000), 150)) for k in (1, 2)}
    (tmp_path / "all.map").write_text("".join(f"{k} s 0 {p}\n" for k, x in everything.items() for p in x))
    files = []
    for name in "ab":
        (tmp_path / f"{name}.txt").write_text("CHR POS\n" + "".join(f"{k} {p}\n" for k, x in everything.items() for p in draw.sample(x, 20)))
        files.append(f"file://{tmp_path}/{name}.txt")
    for test in ("overlap", "distance"):
        s = workflow.run_study(spark, f"file://{tmp_path}/all.map", files, f"file://{tmp_path}/{test}", test=test, replicates=12, null_replicates=30, alpha=0.3)
        rows = s.pvalues.collect()
        assert len(rows) == 24 and s.expected_fwer == pytest.approx(1 - 0.7**2)
        share = sum(r["p_value"] <= 0.3 for r in rows) / 24
        assert s.summary.first()["mean_rate"] == pytest.approx(share) and s.rates.where("universe_id is null and chrom is null").first()["rate"] == pytest.approx(share)
        any_ = {r["replicate"] for r in rows if r["p_value"] <= 0.3}
        assert s.fwer.where("universe_id is null").first()["fwer"] == pytest.approx(len(any_) / 12)
        assert spark.read.csv(f"file://{tmp_path}/{test}/top", sep="\t", header=True).count() == s.top.count() == 2
    u = sites.read_sites(spark, f"file://{tmp_path}/all.map")
    several = u.select(F.lit("x").alias("scenario"), F.lit(0).alias("universe_id"), "chrom", "pos").unionByName(u.where("pos % 2 = 0").select(F.lit("x").alias("scenario"), F.lit(1).alias("universe_id"), "chrom", "pos"))
    s = workflow.study(u, cands(spark, [x[:20] for x in (everything[1], everything[1][9:])]), replicates=10, universes=several, alpha=0.4)
    assert s.summary.first()["n_eff"] == 2 and s.summary.first()["sd_rate"] is not None


def test_calibration_ranks_equal_all_pairs(spark):
    """b of each replicate by ranks against comparing it with every null."""
    u = uni(spark, random.Random(5).sample(range(900), 60))
    n = spark.createDataFrame([(1, 1, 4), (2, 1, 3)], "method int, chrom int, n long")
    got = {r["replicate"]: r["p_value"] for r in calibrate.calibrate_distance(u, n, 15, 25, 7).collect()}
    tag = calibrate.keyed(u)
    null = profiles.samples(resample.sample_without_replacement(tag, n, 25, 7, keys=("scenario", "universe_id")), ("scenario", "universe_id", "replicate", "chrom"))
    expected = profiles.expected_of(null, ("scenario", "universe_id"))
    tried = profiles.samples(resample.sample_without_replacement(tag, n, 15, 8, keys=("scenario", "universe_id")), ("scenario", "universe_id", "replicate", "chrom"))
    nulls, own = (profiles.summaries_of(x, expected, ("scenario", "universe_id")).collect() for x in (null, tried))
    middle = distances.distance_medians(expected, "avg_dist").first()["median"]
    for r in own:
        b = sum(x["entropy"] >= r["entropy"] and x["median"] <= middle for x in nulls)
        assert got[r["replicate"]] == pytest.approx(1 if r["median"] > middle else (b + 1) / 26)


def test_samples_of_one_task_equal_rows_of_draws(spark):
    """Samples drawn until they are full against one row for each draw: small and large ones, a whole universe, repeated sites, several blocks."""
    u = uni(spark, [*range(0, 18_000, 2), 10, 10]).union(uni(spark, [5, 6, 7], 2))
    n = spark.createDataFrame([(1, 1, 700), (2, 1, 8_000), (3, 1, 9_002), (1, 2, 1), (2, 2, 3)], "method int, chrom int, n long")
    one, rows = (resample.sample_indices(u, n, 2, 9, most=most).collect() for most in (resample.MOST_DRAWN, 0))
    assert len(one) == 2 * (700 + 8_000 + 9_002 + 4) and sorted(one) == sorted(rows)
    assert sorted(resample.sample_indices(u, n, 2, 9, most=3).collect()) == sorted(one)


def test_small_chromosomes_equal_blocks(spark):
    """All replicates of a chromosome in one go against blocks of ranks, in the test and in its calibration: repeated sites, one method only, samples of more than half a universe, large and small chromosomes together."""
    rng = random.Random(8)
    u = uni(spark, [*rng.choices(range(400), k=70), 3, 3]).union(uni(spark, range(0, 90, 9), 2)).union(uni(spark, [1, 2], 3)).union(uni(spark, range(300), 4))
    c = cands(spark, [rng.sample(range(400), 9), rng.sample(range(400), 50)]).union(cands(spark, [[1, 5, 7], [9], [2, 3]], 2)).union(cands(spark, [[4]], 3)).union(cands(spark, [range(40), range(30)], 4))
    key = lambda t: sorted(tuple(round(x, 9) if isinstance(x, float) else -1 if x is None else x for x in r) for r in t.select(sorted(t.columns)).collect())
    for sampler in resample.DRAWS:
        for truncate in (False, True):
            got = [[key(x) for x in resample.held_against(u, c, 7, 5, sampler, truncate, most)] for most in (1 << 21, 2000, 0)]
            assert got[0] == got[1] == got[2] and len(got[0][0]) == 3 and len(got[0][1]) == 21
    n = c.groupBy("method", "chrom").agg(F.count("*").alias("n"))
    tag = lambda t, k: t.selectExpr("'x' as scenario", f"{k} as universe_id", "chrom", "pos")
    both = tag(u, 0).union(tag(u.where("pos % 3 > 0"), 1))
    rates = [key(calibrate.calibrate_distance(both, n, 4, 6, 5, most=most)) for most in (1 << 21, 2000, 0)]
    assert rates[0] == rates[1] == rates[2] and len(rates[0]) == 2 * 4 * 4


def test_large_samples_by_bins_of_keys(spark):
    """Samples whose keys are put in order in bins against those sorted as a whole; repeated rows of the sites change no count of an overlap."""
    u = uni(spark, [*range(0, 900, 3), 9, 9]).union(uni(spark, [5, 6, 7], 2))
    n = spark.createDataFrame([(1, 1, 70), (2, 1, 200), (3, 1, 302), (1, 2, 2)], "method int, chrom int, n long")
    whole, bins = (sorted(resample.sample_without_replacement(u, n, 2, 9, most=most).collect()) for most in (4096, 8))
    assert len(whole) == 2 * 574 and bins == whole


def test_histogram_of_small_chromosomes(spark, monkeypatch):
    from siteoverlap.operators import small
    from siteoverlap.plans import queries

    draw = random.Random(6)
    everything = {1: [draw.randrange(5000) for _ in range(90)], 2: [draw.randrange(10**6) for _ in range(300)], 3: [7] * 9, 4: list(range(12)), 5: list(range(40))}
    u = spark.createDataFrame([(c, p) for c, pos in everything.items() for p in pos], "chrom int, pos long")
    sets = {1: [everything[1][:20], everything[1][20:33], everything[1][5:9]], 2: [everything[2][:70], everything[2][100:160], everything[2][:40]], 3: [[7, 7], [7], []], 4: [list(range(12)), [3, 4], list(range(15))], 5: [[1, 2, 3], [], []], 6: [[1], [2], []]}
    c = spark.createDataFrame([(m, k, p) for k, some in sets.items() for m, pos in enumerate(some, 1) for p in pos], "method int, chrom int, pos long")
    for sampler in (resample.sample_without_replacement, resample.sample_indices):
        n = c.groupBy("method", "chrom").agg(F.count("*").alias("n"))
        expected = resample.expected_profile(resample.replicate_profiles(sampler(u, n, 3, 4))).withColumn("avg_dist", F.round("avg_dist", 6))
        want = sorted(distances.distance_histogram(profiles.profile_of(c), expected).collect())
        assert {r["chrom"] for r in want} == {1, 2, 3, 4}
        for most in (small.MOST_DISTANCES, 3000, 0):  # all small, some, none
            assert sorted(resample.distance_histogram(u, c, 3, 4, sampler, most=most).collect()) == want
    monkeypatch.setattr(small, "MOST_HELD", 5)  # a batch for each chromosome
    assert sorted(resample.distance_histogram(u, c, 3, 4, resample.sample_indices).collect()) == want

    def rows(*_):
        raise AssertionError("rows of distances for small chromosomes")

    for module, name in ((profiles, "profile_of"), (profiles, "expected_of"), (resample, "profile_of"), (resample, "expected_of")):
        monkeypatch.setattr(module, name, rows)
    if os.path.isdir("/root/testdata/sf0.001"):
        assert queries.distance_histogram(spark, "/root/testdata/sf0.001").count() > 0


def test_samples_by_place_without_rows_of_draws(spark, monkeypatch):
    """Draws that were rows, ranked in a task, took most memory."""

    def ranked(*_):
        raise AssertionError("a row for each draw")

    monkeypatch.setattr(resample, "enough", ranked)
    u, n = uni(spark, range(40)), spark.createDataFrame([(1, 1, 12), (2, 1, 30)], "method int, chrom int, n long")
    assert {tuple(r) for r in resample.sample_indices(u, n, 2, 9).groupBy("method").agg(F.count("*")).collect()} == {(1, 24), (2, 60)}


def test_draws_do_not_pass_the_driver(spark):
    """Few large samples: Spark took their draws for as small as the table of sizes and broadcast them all."""
    u, n = uni(spark, range(9_000)), spark.createDataFrame([(1, 1, 2_000), (2, 1, 3_000)], "method int, chrom int, n long")
    drawn = resample.sample_indices(u, n, 3, 9)
    assert len(drawn.collect()) == 3 * 5_000
    plan = drawn._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :|+-"))
    sent = [k for k, line in enumerate(plan) if "BroadcastExchange" in line]
    below = [next((j for j in range(k + 1, len(plan)) if depth(plan[j]) <= depth(plan[k])), len(plan)) for k in sent]
    assert any("MapInArrow" in line for line in plan)
    assert not any("MapInArrow" in line for k, j in zip(sent, below, strict=True) for line in plan[k:j])


def test_overlaps_by_place_equal_rows(spark, monkeypatch):
    """Samples compared by place against rows of sites: several universes, windows, a method that is missing or beyond those tested, whole universes, a position that is null, chromosomes with larger samples."""
    from siteoverlap import workflow

    tag = lambda t, k: t.selectExpr("'x' as scenario", f"{k} as universe_id", "chrom", "pos")
    u = uni(spark, range(0, 9_000, 2)).union(uni(spark, [3, 4, 8, 9, 30], 2)).union(uni(spark, range(50), 3)).union(uni(spark, [1], 5))
    u = tag(u, 0).union(tag(u.where("pos % 3 > 0"), 1)).union(tag(u.union(u), 2))
    null = u.union(spark.createDataFrame([("x", 0, 3, None)], u.schema))
    sizes = [(1, 1, 900), (2, 1, 2_000), (3, 1, 4_500), (1, 2, 2), (2, 2, 3), (3, 2, 9), (1, 3, 20), (3, 3, 30), (1, 5, 1), (2, 5, 1), (3, 5, 1)]
    n = spark.createDataFrame(sizes, "method int, chrom int, n long")
    key = lambda t: sorted(tuple(r) for r in t.collect())
    for sites_, methods, window in ((null, 3, 1), (u, 2, 7)):  # of two the third is beyond
        rows = key(calibrate.calibrate_overlap(sites_, n, methods, 4, 5, window, lambda *x: calibrate.overlap_pvalues(*x), resample.sample_indices))
        assert key(calibrate.calibrate_overlap(sites_, n, methods, 4, 5, window, sampler=resample.sample_indices)) == rows and len(rows) == 3 * 4 * 5
    units = calibrate.units_of(u, 1)
    one, larger = (key(calibrate.pvalues_by_place(units, n, 3, 4, 5, most)) for most in (resample.MOST_DRAWN, 40))
    assert one == larger and len({p for *_, p in one}) > 6

    def drawn(*_):
        raise AssertionError("a row for each block of a sample")

    monkeypatch.setattr(resample, "drawn_blocks", drawn)
    u, c = uni(spark, range(400)), cands(spark, [range(90), range(50, 200), range(0, 400, 3)])
    assert workflow.study(u, c, replicates=10, alpha=0.5).top.first()["rate"] > 0
