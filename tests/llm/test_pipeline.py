"""The pipeline against plain versions of its stages."""

import hashlib
import random

import corpus_pipeline as c
import public_tokenizers as P
import tiktoken
from siteoverlap.llm import bpe
from siteoverlap.llm.queries import TOKENIZER

from .test_jaccard import plain_classes


def write(spark, folder):
    draw = random.Random(8)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(draw.randint(2, 7)))
    passage = " ".join(word() for _ in range(20))
    docs, labels = [], []
    for k in range(260):
        words = [word() for _ in range(80)]
        good = int(draw.random() < 0.75)
        text = " ".join(words) if good else " | ".join(words)
        docs.append([k, text, "en", "src", len(text)])
        labels.append((k, good, 0))
    for k in range(260, 280):  # near copies
        text = docs[k - 260][1] + " " + word()
        docs.append([k, text, "en", "src", len(text)])
    docs[30][1] += " " + passage
    docs[31][1] += ' token = "b44e15e09fd311c3cf3163b66d5a9875b883d8ce" end'
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs, dict((k, g) for k, g, _ in labels), passage


def test_stages_and_run(spark, tmp_path):
    folder = f"file://{tmp_path}"
    docs, good, passage = write(spark, folder)
    d = spark.read.parquet(f"{folder}/documents.parquet")
    first = c.STAGES[0][1](spark, d, folder)
    assert first.columns == d.columns
    kept = {r["doc_id"]: r["text"] for r in first.collect()}
    right = [(k in kept) == bool(g) for k, g in good.items()]
    assert sum(right) > 0.95 * len(right)

    once = c.STAGES[1][1](spark, first, folder)
    want = {i for i, _, least in plain_classes(list(kept), list(kept.values()), 5, 80) if i == least}
    assert {r["doc_id"] for r in once.collect()} == want and once.columns == d.columns

    clean = c.STAGES[2][1](spark, once, folder)
    want = {k for k in want if passage not in kept[k]}
    assert {r["doc_id"] for r in clean.collect()} == want and clean.columns == d.columns

    bare = c.STAGES[3][1](spark, clean, folder)
    texts = {r["doc_id"]: r["text"] for r in bare.collect()}
    assert bare.columns == d.columns and texts.keys() == want
    assert {k for k in want if texts[k] != kept[k]} == ({31} & want)
    assert all("b44e15" not in t for t in texts.values()) and all(r["n_chars"] == len(r["text"]) for r in bare.collect())

    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path(TOKENIZER)), special_tokens={})
    out = {r["doc_id"]: r for r in c.run(spark, folder).collect()}
    assert out.keys() == want
    for k, r in out.items():
        ids = library.encode_ordinary(texts[k])
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and r["decoded_sha256"] == hashlib.sha256(texts[k].encode()).hexdigest()


def test_nulls_empties_and_extra_columns(spark, tmp_path):
    folder = f"file://{tmp_path}"
    docs = [(1, None, "x", 0, "y"), (2, "", "x", 0, "y"), (None, "a b", "x", 2, "y"), (3, "a b c", None, 5, None), (3, "a b c", None, 5, None)]
    spark.createDataFrame(docs, "doc_id long, text string, component string, n_chars long, `clean text` string").withColumnRenamed("clean text", "found").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert len(c.run(spark, folder).collect()) == 5
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/none/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").write.parquet(f"{folder}/none/{name}.parquet")
    assert c.run(spark, f"{folder}/none").collect() == []
