"""The byte network: table form against a plain convolution, and held-out accuracy."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from siteoverlap.llm import quality as q


def plain(text, p):
    w = p["filters"].reshape(q.WIDTH, q.EMBED, q.FILTERS)
    raw = text.encode()
    b, n = np.frombuffer(raw + b"\0" * (q.WIDTH + 1), np.uint8), max(1, len(raw))
    act = np.stack([sum(p["embed"][b[i + j]] @ w[j] for j in range(q.WIDTH)) + p["bias"] for i in range(n)])
    act, segments = np.maximum(act, 0), -(-n // q.SEGMENT)
    chunks = np.array([act[c * q.SEGMENT : (c + q.CHUNK) * q.SEGMENT].max(0) for c in range(0, max(1, segments - 1), q.STRIDE)])
    return np.concatenate([chunks.mean(0), chunks.max(0), chunks.min(0)])


def test_tables_equal_convolution():
    rng = np.random.default_rng(0)
    p = {"embed": rng.normal(size=(256, q.EMBED)).astype(np.float32), "filters": rng.normal(size=(q.WIDTH * q.EMBED, q.FILTERS)).astype(np.float32), "bias": rng.normal(size=q.FILTERS).astype(np.float32)}
    texts = ["", "a", "hello" * 100, "x" * 128, "y" * 129, "é" * 300, "z" * 512, "q" * 513, "", "word " * 2000]
    got = q.document_features(pa.array(texts), q.pair_tables(p))
    assert np.abs(got - np.array([plain(t, p) for t in texts])).max() < 1e-3


def corpus(spark):
    rng = np.random.default_rng(1)
    rows = []
    for k in range(600):
        words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(80)]
        good = int(rng.random() < 0.7)
        rows.append((k, " ".join(words) if good else " | ".join(words), good, "x", 1.0))
    return spark.createDataFrame(rows, "doc_id long, text string, quality int, id string, score double")


def test_held_out_accuracy(spark):
    docs = corpus(spark)
    model = q.train(docs, docs.select("doc_id", "quality"))
    got = q.score(docs, model).join(docs.select("doc_id", "quality"), "doc_id").where(q.held_out(F.col("doc_id"))).collect()
    assert len(got) > 100 and np.mean([(r["score"] >= 0.7) == bool(r["quality"]) for r in got]) > 0.95


def test_no_labels_nulls_and_repeats(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (2, ""), (3, "text")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, None)], "doc_id long, quality int")
    assert q.train(docs, labels) is None
    assert sorted((r["doc_id"], r["score"]) for r in q.score(docs, None).collect()) == [(1, 0.5), (2, 0.5), (2, 0.5), (3, 0.5)]
    one = q.train(docs, spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "doc_id long, quality int"))
    assert all(0 <= r["score"] <= 1 for r in q.score(docs, one).collect())
    assert q.score(docs.where("false"), one).collect() == []


def test_chunks_cover_whole_texts():
    for n in (0, 1, 127, 128, 129, 511, 512, 513, 5000, 100_001):
        raw = bytes(np.random.default_rng(n).integers(1, 256, n, dtype=np.uint8))
        chunks, step = q.chunks_of(raw), q.SEGMENT * q.STRIDE
        assert len(chunks) == max(1, -(-(-(-n // q.SEGMENT) - 1) // q.STRIDE))
        whole = raw + bytes(q.SEGMENT * q.CHUNK + q.WIDTH)
        assert all(bytes(c) == whole[k * step : k * step + len(c)].ljust(len(c), b"\0") for k, c in enumerate(chunks))
        assert (len(chunks) - 1) * step + q.SEGMENT * q.CHUNK >= n


def test_sample_is_bounded_by_rows_and_texts_are_whole(spark):
    long_text = "word " * 300_000
    docs = spark.createDataFrame([(1, "a"), (1, "b"), (1, None), (2, long_text), (3, "c"), (4, "d")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 5)] + [(1, 0)], "doc_id long, quality int")
    rows = q.training_rows(docs, labels, "doc_id", "text", "quality", 100)
    assert len({r[0] for r in rows}) == len(rows) <= 4 and all(t == long_text for i, _, t in rows if i == 2)
    assert len(q.training_rows(docs, labels, "doc_id", "text", "quality", 1)) == 1
    model = q.train(docs, labels)
    assert q.score(docs, model).count() == 6
    clash = docs.withColumnsRenamed({"text": "value"}).withColumns({"id": F.lit(1), "score": F.lit("x"), "made": F.lit(2)})
    assert q.good(clash, model, 0.0, "value").count() == 6 and q.good(clash, model, 0.0, "value").columns == clash.columns
