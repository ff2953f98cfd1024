"""Decontamination against a full edit-distance table."""

import random

import numpy as np
import pytest
from siteoverlap.llm import decontaminate as d


def least_edits(item, text):
    """Least edits between the item and any part of the text."""
    row = np.zeros(len(text) + 1, int)
    for c in item:
        new = np.minimum(row[1:] + 1, row[:-1] + (np.array(list(text)) != c)) if text else np.zeros(0, int)
        first, out = row[0] + 1, [row[0] + 1]
        for v in new:
            out.append(min(v, out[-1] + 1))
        row = np.array(out)
        assert row[0] == first
    return int(row.min())


def edited(draw, text, n):
    text = list(text)
    for _ in range(n):
        k = draw.randrange(len(text))
        text[k : k + 1] = draw.choice([[], [draw.choice("abcdé")], [text[k], draw.choice("abc ")]])
    return "".join(text)


@pytest.mark.parametrize("seed", range(12))
def test_finds_all_within_the_budget(seed):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdeé") for _ in range(draw.randint(2, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [prose(draw.randint(4, 40)) for _ in range(8)] + ["short", ""]
    index = d.Index([(k, t.encode()) for k, t in enumerate(items)])
    texts = []
    for _ in range(12):
        item = draw.choice(items[:8])
        n = int(len(item.encode()) * d.ERRORS)
        texts.append(prose(draw.randint(0, 30)) + " " + edited(draw, item, draw.randint(0, n + 4)).upper() + "\n" + prose(draw.randint(0, 30)))
    texts += ["", items[0], prose(300)]
    raw = [t.encode() for t in texts]
    off = np.concatenate([[0], np.cumsum([len(t) for t in raw])])
    found = {(t, i): e for t, i, _, _, e in d.matches(index, d.folded(b"".join(raw)), off)}
    for t, text in enumerate(raw):
        for i, item in enumerate(items[:8]):
            want = least_edits(d.folded(item.encode()).tolist(), d.folded(text).tolist())
            if want <= index.edits[i]:
                assert found[t, i] == want
            else:
                assert (t, i) not in found


def test_rows_spans_and_blocks(spark, monkeypatch):
    passage = "The quick brown fox jumps over the lazy dog while the band plays on"
    docs = spark.createDataFrame(
        [(1, f"é {passage} end", 0), (2, passage.replace(" fox", " fax").upper(), 0), (3, "nothing of the kind", 0), (4, None, 0), (5, "", 0), (1, f"é {passage} end", 0)], "doc_id long, text string, item_id int"
    )
    bench = spark.createDataFrame([(7, passage), (8, "x" * 40), (9, None), (10, "dog")], "item_id long, text string")
    want = sorted([(1, 7, 2, 2 + len(passage), 0)] * 2 + [(2, 7, 0, len(passage), 1)])
    assert sorted(map(tuple, d.leaks(docs, bench).collect())) == want
    monkeypatch.setattr(d, "BLOCK_BYTES", 30)
    assert sorted(map(tuple, d.leaks(docs, bench).collect())) == want
    assert sorted(r["doc_id"] for r in d.clean(docs, bench).collect()) == [3, 4, 5]
    assert d.leaks(docs, bench.where("false")).count() == 0 and d.leaks(docs.where("false"), bench).count() == 0


def test_repetitive_texts_are_found_and_cheap():
    import time

    phrase = "all work and no play makes a dull boy "
    items = [(k, (phrase * 12).encode()[k : k + 400]) for k in range(20)] + [(99, b"something else entirely, said the other one of them")]
    index = d.Index(items)
    text = d.folded((phrase * 110).encode())
    off = np.array([0, len(text)])
    assert sum(len(post) for _, post in index.hits(text)) < 1_500_000
    assert {i for _, i, *_ in d.matches(index, text, off)} == set(range(20))
    broken = d.folded((phrase * 3 + "xyz " * 20 + phrase * 3).encode())
    found = {i for _, i, *_ in d.matches(index, broken, np.array([0, len(broken)]))}
    assert found == {i for i in range(20) if least_edits(index.texts[i].tolist(), broken.tolist()) <= index.edits[i]}
    began = time.time()
    d.matches(index, d.folded((phrase * 2000).encode()), np.array([0, 2000 * len(phrase)]))
    assert time.time() - began < 40


def test_rows_are_judged_by_their_own_text(spark):
    passage = "The quick brown fox jumps over the lazy dog while the band plays on"
    docs = spark.createDataFrame([(None, passage, 1, "x"), (None, "clean", 2, "x"), (1, passage, 3, "x"), (1, "clean", 4, "x"), (2, None, 5, "x")], "doc_id long, text string, item_id int, bytes string")
    bench = spark.createDataFrame([(7, passage), (None, passage)], "item_id long, text string")
    assert sorted(r["item_id"] for r in d.clean(docs, bench).collect()) == [2, 4, 5] and d.clean(docs, bench).columns == docs.columns
    assert d.clean(docs, bench.where("false")).count() == 5 and d.clean(docs.where("false"), bench).count() == 0
    assert sorted((r["doc_id"] or 0, r["item_id"] or 0) for r in d.leaks(docs, bench).collect()) == [(0, 0), (0, 7), (1, 0), (1, 7)]
