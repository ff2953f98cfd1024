"""Near-duplicate classes against all pairs."""

import random
import re

import pyarrow as pa
import pytest
from siteoverlap.llm import jaccard as j


def plain_sets(texts, k):
    out = []
    for t in texts:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        out.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    return out


def plain_classes(ids, texts, k, percent):
    sets, parent = plain_sets(texts, k), list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    least = {}
    for i, x in enumerate(ids):
        least[root(i)] = min(least.get(root(i), x), x)
    return [(x, len(sets[i]), least[root(i)]) for i, x in enumerate(ids)]


def corpus(seed):
    draw = random.Random(seed)
    words = ["".join(draw.choice("abcdefé") for _ in range(draw.randint(1, 5))) for _ in range(400)]
    base = [[draw.choice(words) for _ in range(draw.choice([1, 3, 4, 8, 30, 120]))] for _ in range(12)]
    passage = [draw.choice(words) for _ in range(25)]
    texts = []
    for _ in range(110):
        w = list(draw.choice(base))
        for _ in range(draw.randint(0, max(1, len(w) // 25))):
            at = draw.randrange(len(w) + 1)
            w[at : at + draw.randint(0, 1)] = [draw.choice(words)] * draw.randint(0, 1)
        if draw.random() < 0.3:
            w += passage
        texts.append(draw.choice([" ", "\n", "  "]).join(x.upper() if draw.random() < 0.02 and x.isascii() else x for x in w))
    return [*texts, "", None, " \t ", texts[0], texts[1].upper() if texts[1].isascii() else texts[1]]


def rows(spark, texts):
    return spark.createDataFrame([(k * 3 + 1, t, "x", 5) for k, t in enumerate(texts)], "doc_id long, text string, vertex string, component int")


@pytest.mark.parametrize(("seed", "k", "percent", "part", "few"), [(1, 4, 85, 2048, 4), (3, 4, 70, 3, 0)])
def test_classes_equal_all_pairs(spark, monkeypatch, seed, k, percent, part, few):
    monkeypatch.setattr(j, "PART", part)
    monkeypatch.setattr(j, "FEW_PAIRS", few)
    monkeypatch.setattr(j, "SAMPLE_TEXTS", 60)
    texts = corpus(seed)
    got = sorted(map(tuple, j.near_duplicates(rows(spark, texts), k, percent).collect()))
    assert got == sorted(plain_classes([k * 3 + 1 for k in range(len(texts))], texts, k, percent))


def test_trees_drop_no_link():
    texts = [t for t in corpus(9) if t and t.strip()]
    sets = j.shingle_sets(pa.array(texts), 4)
    names = {}
    rows = []
    for s in sets:
        v = j.fingerprint(s)
        if v not in names:
            names[v] = s
            rows.append((v, len(s), j.bitmap(s), v, 0))
    same = lambda a, b: len(set(names[a].tolist()) & set(names[b].tolist()))
    links = {(a, b) for a in names for b in names if a < b and 100 * (o := same(a, b)) >= 80 * (len(names[a]) + len(names[b]) - o)}
    pairs, whole = j.tree_pairs(rows, 80)
    assert whole and links and links <= set(pairs)
    few, whole = j.tree_pairs(rows, 80, 1)
    assert not whole and set(few) < set(pairs) and {v for p in few for v in p} == {v for p in pairs for v in p}
    two = [(*r[:4], r[0] % 2) for r in rows]
    assert {p for p in links if p[0] % 2 != p[1] % 2} <= set(j.tree_pairs(two, 80)[0])
    assert all(j.may_link(len(names[a]), j.bitmap(names[a]), len(names[b]), j.bitmap(names[b]), 80) for a, b in links)
    for a, b in links:  # any order of tokens keeps a common token in both prefixes
        often = j.np.unique(names[a][::2])
        assert set(j.prefix(names[a], often, 80).tolist()) & set(j.prefix(names[b], often, 80).tolist())


def test_shingles_are_counted_as_plain_sets():
    texts = corpus(4)
    got = j.shingle_sets(pa.array(texts, pa.string()), 4)
    assert [len(s) for s in got] == [len(s) for s in plain_sets(texts, 4)]
    assert (got[0] == j.shingle_sets(pa.array(["pad pad", texts[0]]), 4)[1]).all()


def test_components_of_a_chain(spark):
    draw = random.Random(2)
    chain = [(k, k + 1) for k in range(40)] + [(100, 101), (200, 300), (300, 250)]
    draw.shuffle(chain)
    got = {r[0]: r[1] for r in j.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 200: 200, 300: 200, 250: 200}


def test_one_of_each_class_and_empty(spark):
    docs = rows(spark, ["a b c d e f g h", "a b c d e f g h", None, "", "z"])
    assert sorted(r["doc_id"] for r in j.first_of_each_class(docs).collect()) == [1, 7, 10, 13]
    assert j.near_duplicates(docs.where("false")).collect() == []


def test_rows_without_id_and_shared_ids(spark):
    text = "one two three four five six seven eight"
    docs = spark.createDataFrame([(None, text, "a"), (5, text, "b"), (5, "quite another text of some words here", "c"), (None, "lonely text with no copy at all", "d"), (None, "LONELY text with no copy at all", "e")], "doc_id long, text string, mark string")
    kept = {r["mark"] for r in j.first_of_each_class(docs).collect()}
    assert {"b", "c"} <= kept and len(kept & {"d", "e"}) == 1 and "a" not in kept


@pytest.mark.parametrize("percent", [70, 80, 85, 100])
def test_rows_with_partners_of_fitting_size_stay(spark, percent):
    sizes = [(a, b) for a in range(1, 130) for b in range(a, 130) if 100 * a >= percent * b]
    blocks = spark.createDataFrame([(c, 2 * c + k, n) for c, pair in enumerate(sizes) for k, n in enumerate(pair)] + [(-1, -1, 5), (-1, -2, 500)], "centre long, vertex long, n int")
    got = j.with_partners(blocks, percent)
    assert got.where("centre >= 0").count() == 2 * len(sizes) and got.where("centre < 0").count() == 0
