"""Nearest neighbours against brute force."""

import numpy as np
import pytest
from siteoverlap.llm import ann


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, id string, vec int, label int")


def brute(rows, queries, n):
    good = {}
    longest = max((len(v) for _, v, *_ in rows if v is not None), default=0)
    for i, v, *_ in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[i] = np.pad(np.array(v, np.float32).astype(float), (0, longest - len(v)))
    out = []
    for q in queries:
        if q in good:
            near = sorted((float(np.sqrt(((good[i] - good[q]) ** 2).sum())), i) for i in good if i != q)[:n]
            out += [(q, k, i, round(d, 9)) for k, (d, i) in enumerate(near, 1)]
    return sorted(out)


def rows():
    rng = np.random.default_rng(3)
    out = [(k, [float(np.float32(x)) for x in rng.normal(size=6)], "x", 1, 0) for k in range(300)]
    out += [(1000 + k, out[7][1], "x", 1, 0) for k in range(40)]  # equal vectors
    out += [(2000, None, "x", 1, 0), (2001, [0.0] * 6, "x", 1, 0), (2002, [float("nan")] * 6, "x", 1, 0), (2003, [1.0] * 5, "x", 1, 0), (2004, [1.0, None, 0.0, 0.0, 0.0, 0.0], "x", 1, 0), (2005, [float("inf")] * 6, "x", 1, 0), (None, [1.0] * 6, "x", 1, 0)]
    return [*out, out[0], out[0]]


def test_nearest_equal_brute_force(spark):
    data = rows()
    asked = [*range(0, 300, 20), 7, 1010, 2000, 2001, 2003]
    docs = table(spark, data)
    got = ann.nearest_neighbours(docs, docs.where(docs["vec_id"].isin(asked)))
    assert sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in got.collect()) == brute(data, asked, 10)


def test_empty_and_few(spark):
    none = table(spark, rows()).where("false")
    assert ann.nearest_neighbours(none, none).collect() == []
    two = table(spark, [(1, [1.0, 0.0], "x", 1, 0), (2, [0.0, 1.0], "x", 1, 0)])
    assert sorted(tuple(r)[:3] for r in ann.nearest_neighbours(two, two).collect()) == [(1, 1, 2), (2, 1, 1)]


def test_lists():
    ids, d, new = ann.nearest(np.array([5, 3, 5, 1, 3]), np.array([0.2, 0.1, 0.2, 0.1, 0.1], np.float32), np.array([True, True, False, True, False]), 2)
    assert ids.tolist() == [1, 3] and np.allclose(d, 0.1) and new.tolist() == [True, False]
    assert [len(x) for x in ann.nearest(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, bool), 2)] == [0, 0, 0]


def test_batches_without_proposals(spark):
    """A settled graph: no vertex has anything new to propose, in any partition."""
    rng = np.random.default_rng(2)
    vectors = spark.createDataFrame([(k, [float(x) for x in rng.normal(size=4)]) for k in range(40)], "vertex long, vec array<double>")
    codes, kind = ann.packed(vectors)
    graph = ann.neighbour_graph(vectors, 39)
    for state in (graph, graph.withColumn("fresh", ann.F.transform("ids", lambda _: ann.F.lit(True)))):
        after = ann.descent(state.repartition(211), codes, kind, 39, 9).collect()
        assert sorted((r["vertex"], r["ids"]) for r in after) == sorted((r["vertex"], r["ids"]) for r in graph.collect())
        assert not any(x for r in after for x in r["fresh"])


def test_recall_with_a_beam_smaller_than_the_table(spark):
    rng = np.random.default_rng(6)
    points = rng.normal(size=(3000, 24)).astype(np.float32).astype(float)
    docs = spark.createDataFrame([(k, p.tolist()) for k, p in enumerate(points)], "vec_id long, embedding array<double>")
    asked = list(range(0, 3000, 100))
    got = ann.nearest_neighbours(docs, docs.where("vec_id % 100 = 0"), beam=64).collect()
    want = {(q, int(x)) for q in asked for x in np.argsort(((points - points[q]) ** 2).sum(1), kind="stable")[1:11]}
    assert len(got) == 300 and len({(r["query_id"], r["vec_id"]) for r in got} & want) >= 0.9 * len(want)


def test_descent_runs_until_lists_settle(spark, monkeypatch):
    vectors = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(12)], "vertex long, vec array<double>")

    def slow(graph, codes, kind, k, turn):  # a list that still changes in the seventh round
        return graph.withColumn("ids", ann.F.array(ann.F.lit(100 + min(turn, 6)).cast("long")))

    monkeypatch.setattr(ann, "descent", slow)
    assert {r["ids"][0] for r in ann.neighbour_graph(vectors).collect()} == {106}


def test_effort_follows_the_vertices():
    small, large = 51_282, 15_000_000
    for effort in (ann.rounds_of, ann.pivots_of, ann.beam_of):
        assert effort(large) > effort(small) >= effort(1000) > 0
    assert (ann.rounds_of(small), ann.pivots_of(small), ann.beam_of(small)) == (ann.ROUNDS, ann.PIVOTS, ann.BEAM)


def test_huge_row_and_dense_cluster(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=6)
    points = [*rng.normal(size=(300, 6)), *(base + 1e-4 * rng.normal(size=(900, 6))), np.full(6, 1e6)]
    data = [(k, [float(np.float32(x)) for x in p], "x", 1, 0) for k, p in enumerate(points)]
    asked = [*range(0, 1200, 60), 1200]
    docs = table(spark, data)
    got = ann.nearest_neighbours(docs, docs.where(docs["vec_id"].isin(asked)))
    assert sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in got.collect()) == brute(data, asked, 10)


def test_packed_keeps_doubles(spark):
    for value, kind in ((0.5, "<f4"), (0.1, "<f8"), (1e300, "<f8")):
        codes, found = ann.packed(spark.createDataFrame([(1, [value, 1.0])], "vertex long, vec array<double>"))
        assert found == kind and ann.unpacked([bytes(codes.first()["code"])], kind).tolist() == [[value, 1.0]]


@pytest.mark.parametrize("n", [60, 1500])
def test_vectors_that_share_an_id(spark, n):
    """Each is a row of its own, as query and as candidate; 1,500 vectors make several blocks."""
    rng = np.random.default_rng(9)
    points = np.round(rng.normal(size=(n, 4)), 3)
    ids = [k // 2 if k < 20 else k for k in range(n)]
    ids[30], points[31] = 0, points[30]
    data = [(i, p.tolist()) for i, p in zip(ids, points, strict=True)]
    docs = spark.createDataFrame([*data, data[0], data[30]], "vec_id long, embedding array<double>")
    got = ann.nearest_neighbours(docs, docs.where("vec_id in (0, 1, 5, 31, 40)"), beam=n).collect()
    want = []
    for q in range(n):
        if ids[q] in (0, 1, 5, 31, 40):
            near = sorted((float(np.sqrt(((points[x] - points[q]) ** 2).sum())), ids[x]) for x in range(n) if x != q)[:10]
            want += [(ids[q], k, i, round(d, 9)) for k, (d, i) in enumerate(near, 1)]
    assert sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in got) == sorted(want)
