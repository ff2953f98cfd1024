"""Line labels and quality rules against plain versions."""

import itertools
import random
import re

import numpy as np
import pytest
from siteoverlap.llm import lines, queries


def plain_rules(text):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    words = word.findall(text)
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    inside = {k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)}
    some = [x for x in text.split("\n") if word.search(x)]
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": sum(x in some[:k] for k, x in enumerate(some)),
        "n_repeat_words": len(inside), "base_failed": len(words) < 50 or 100 * len(inside) > 50 * len(words),
    }


def made(draw, good):
    word = lambda: "".join(draw.choice("abcdefgé") for _ in range(draw.randint(2, 7)))
    sentence = lambda n: (" ".join(word() for _ in range(n)).capitalize() + ".") if good else " | ".join(word() + draw.choice(["###", "", "$$"]) for _ in range(n))
    return "\n".join(sentence(draw.randint(3, 14)) for _ in range(draw.randint(3, 12)))


@pytest.fixture(scope="module")
def tables(spark):
    draw = random.Random(3)
    kinds = [k % 3 > 0 for k in range(300)]
    docs = [(k, made(draw, good) + ("\nAll rights reserved." if k % 2 else ""), "clash") for k, good in enumerate(kinds)]
    extra = [
        (1000, None, ""), (1001, "", ""), (1002, " \n\t\n ", ""), (1003, "one two three", ""), (1004, "a b c " * 40, ""), (1005, "x\ny\nx\n x\r\nx\r\n", ""), (1006, "a b c a b c", ""), (1007, "\x0bword\x1cword\xa0word　word " * 30, ""),
        (1008, "# * $ %" * 30, ""), (1009, "word " * 200_000, ""), (1010, "\n".join(f"line {k} of a very long text." for k in range(20_000)), ""), docs[1], docs[1], (None, docs[1][1], ""),
    ]
    labels = [(k, int(good), "x") for k, good in enumerate(kinds)] + [(5, None, "x"), (None, 1, "x"), (7, int(kinds[7]), "y")]
    d = spark.createDataFrame(docs + extra, "doc_id long, text string, kept string")
    return d, spark.createDataFrame(labels, "doc_id long, quality int, text string"), docs + extra, kinds


def test_rules_and_verdict(spark, tables):
    d, labels, docs, kinds = tables
    got = sorted((r.asDict() for r in lines.judge(d, lines.train(d, labels)).collect()), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))
    kept, share = [r.pop("kept") for r in got], [r.pop("content") for r in got]
    plain = {x: plain_rules(x) if len(x) < 50_000 else None for x in {t or "" for _, t, _ in docs}}
    want = sorted(({"doc_id": i, **(plain[t or ""] or {})} for i, t, _ in docs), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))
    assert len(got) == len(want)
    assert all(g == w for g, w in zip(got, want, strict=True) if len(w) > 1)
    long = {r["doc_id"]: r for r in got if r["doc_id"] in (1009, 1010)}
    assert (long[1009]["n_words"], long[1009]["n_repeat_words"], long[1009]["base_failed"]) == (200_000, 200_000, True) and long[1010]["n_words"] == 140_000
    assert all(k == (not r["base_failed"] and s >= 0.5) for r, k, s in zip(got, kept, share, strict=True))
    judged = [(k, kinds[r["doc_id"]]) for r, k in zip(got, kept, strict=True) if r["doc_id"] is not None and r["doc_id"] < 300 and not r["base_failed"]]
    assert len(judged) > 100 and all(k == good for k, good in judged)


def test_without_labels_and_empty(spark, tables):
    d, labels, docs, _ = tables
    for some in (labels.limit(0), labels.where("quality = 1")):
        assert lines.train(d, some) is None
    got = lines.judge(d, None).collect()
    assert len(got) == len(docs) and all(r["kept"] != r["base_failed"] for r in got)
    assert lines.judge(d.limit(0), None).count() == 0 and lines.train(d.limit(0), labels) is None


@pytest.mark.parametrize("seed", range(5))
def test_viterbi_equals_all_sequences(seed):
    rng = np.random.default_rng(seed)
    score, trans, start = rng.normal(size=7), rng.normal(size=(2, 2)), rng.normal()

    def value(y):
        return sum(s for s, on in zip(score, y, strict=True) if on) + sum(trans[a, b] for a, b in itertools.pairwise(y)) + start * y[0]

    best = max(itertools.product((0, 1), repeat=7), key=value)
    t = trans - trans[0, 0]
    assert lines.viterbi(score.tolist(), t[1, 1], t[0, 1], t[1, 0], start) == [bool(x) for x in best]
    assert lines.viterbi([0.0] * 4, 0.0, 0.0, 0.0, 0.0) == [True] * 4 and lines.viterbi([], 0, 0, 0, 0) == []


def test_fit_is_the_maximum_likelihood():
    """At the optimum the expected counts under the model, by all sequences, equal those of the labels."""
    rng = np.random.default_rng(0)
    chains = [rng.integers(0, 2, (n, len(lines.CUTS))).astype(np.uint8) for n in (1, 3, 4, 4, 2) * 8]
    labels = [rng.random(len(c)) < 0.2 + 0.6 * c[:, 0] for c in chains]
    p = lines.fitted(chains, labels, steps=3000, decay=1e-3)
    expected, counted = np.zeros((len(lines.CUTS), lines.WIDTH)), np.zeros((len(lines.CUTS), lines.WIDTH))
    trans, seen = np.zeros((2, 2)), np.zeros((2, 2))
    for c, y in zip(chains, labels, strict=True):
        e = lines.emissions(c.astype(int), p["weights"])
        every = list(itertools.product((0, 1), repeat=len(c)))
        w = np.array([sum(e[k] for k in range(len(c)) if s[k]) + sum(p["trans"][a, b] for a, b in itertools.pairwise(s)) + p["start"][0] * s[0] for s in every])
        w = np.exp(w - w.max())
        for s, q in zip([*every, tuple(y.astype(int))], [*(w / w.sum()), None], strict=True):
            for k, on in enumerate(s):
                (counted if q is None else expected)[np.arange(len(lines.CUTS)), c[k]] += on * (1 if q is None else q)
            for a, b in itertools.pairwise(s):
                (seen if q is None else trans)[a, b] += 1 if q is None else q
    n = sum(map(len, chains))
    assert np.allclose(expected - counted, -n * 1e-3 * p["weights"], atol=0.05) and np.allclose(trans - seen, -n * 1e-3 * p["trans"], atol=0.05)


def test_op13(spark, tables, tmp_path):
    d, labels, docs, _ = tables
    d.write.parquet(f"file://{tmp_path}/documents.parquet")
    labels.write.parquet(f"file://{tmp_path}/labels.parquet")
    got = queries.op13_lines(spark, f"file://{tmp_path}")
    assert got.columns[:8] == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "content"] and got.count() == len(docs)
