"""Merkle manifests against a plain version."""

import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F
from siteoverlap.llm import merkle, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, tree int"


def h(*digests):
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def leaf(doc, added=0):
    i, text, lang, source, n = doc[:5]
    values = (i, source, lang, None if n is None else n + added, text)
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(digests):
    """The root, and for each leaf its siblings as (digest, left) or None."""
    path, at, level = [[] for _ in digests], list(range(len(digests))), digests
    while len(level) > 1:
        for own, k in zip(path, at, strict=True):
            own.append((level[k ^ 1], k % 2 == 1) if k ^ 1 < len(level) else None)
        level, at = [h(*level[k : k + 2]) for k in range(0, len(level), 2)], [k // 2 for k in at]
    return level[0], path


def plain(docs):
    trees = {}
    for d in docs:
        trees.setdefault(d[2], []).append((d[0] is not None, d[0] or 0, leaf(d), d))
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    made = {name: climb([x[2] for x in sorted(trees[name], key=lambda x: x[:3])]) for name in names}
    root, over = climb([made[name][0] for name in names]) if names else (None, [])
    out = []
    for name, top in zip(names, over, strict=True):
        for (_, _, own, d), path in zip(sorted(trees[name], key=lambda x: x[:3]), made[name][1], strict=True):
            tampered = d[0] is not None and zlib.crc32(str(d[0]).encode()) % 7 == 0
            acc = leaf(d, 1) if tampered else own
            for s in path + top:
                acc = h(acc) if s is None else h(s[0], acc) if s[1] else h(acc, s[0])
            out.append((d[0], own, made[name][0], root, h(*(s[0] for s in path + top if s)), acc, acc == root))
    return sorted(out, key=str)


def rows(spark, docs, path):
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{path}/documents.parquet")
    return sorted((tuple(r) for r in queries.op12_merkle(spark, path).collect()), key=str)


def documents():
    docs = [(k, f"text {k % 40} é" * (k % 4), lang, None if k % 9 == 0 else "s", None if k % 11 == 0 else k % 13, "clash", 1) for lang, n in (("en", 300), ("Z", 1), ("é", 65), (None, 3), ("", 2), ("-", 5)) for k in range(n)]
    docs += [docs[4], docs[4], (None, "no id", "en", None, 3, "", 2), (None, "no id", "en", None, 3, "", 2), (None, None, None, None, None, None, None), (900, "", "Z", "", 0, "", 0), (901, "long " * 200_000, "Z", "s", 9, "", 0)]
    return docs


def test_op12(spark, tmp_path):
    docs = documents()
    got = rows(spark, docs, f"file://{tmp_path}/a")
    assert got == plain(docs) and 0 < sum(not r[-1] for r in got) < len(got)


@pytest.mark.parametrize("sizes", [[1], [2], [256], [257], [1, 1, 1], [513, 5]])
def test_sizes(spark, tmp_path, sizes):
    docs = [(k * 3, f"t{k}", f"l{j}", "s", k, "", 0) for j, n in enumerate(sizes) for k in range(n)]
    assert rows(spark, docs, f"file://{tmp_path}/a") == plain(docs)


def test_sql(spark, tmp_path):
    docs = documents()
    got = rows(spark, docs, f"file://{tmp_path}/a")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/a/documents.parquet/*.parquet'")
    assert sorted(db.sql(queries.OP12_SQL).fetchall(), key=str) == got


def test_empty_table(spark, tmp_path):
    assert rows(spark, [], f"file://{tmp_path}/a") == []


def test_intervals(spark):
    """Blocks of three levels: each node covers the intervals of its children, and what it covers decides its digest."""
    docs = spark.range(600).select(F.lit("t").alias("tree"), "id", F.sha2(F.col("id").cast("string"), 256).alias("digest"))
    nodes, proofs = merkle.manifest(merkle.leaves_of(docs, F.col("tree"), F.col("id"), F.col("digest")))
    own = {(r["level"], r["lo"], r["hi"]): r["digest"] for r in nodes.where("tree <> ''").collect()}
    assert len(own) == sum(-(-600 // 2**k) for k in range(11))
    for (level, lo, hi), digest in own.items():
        assert lo % 2**level == 0 and hi == min(600, lo + 2**level)
        if level:
            mid = lo + 2 ** (level - 1)
            assert digest == h(*(own[x] for x in ((level - 1, lo, min(mid, hi)), (level - 1, mid, hi)) if x in own))
    assert proofs.where(merkle.folded(F.col("digest"), F.col("steps")) != F.col("root")).isEmpty()
