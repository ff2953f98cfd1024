"""The registered queries of this package, their parameters and their SQL.

Each query applies its operator to a whole table and derives the digest columns
of its contract from the operator's own output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, ann, bpe, decontaminate, html_extract, jaccard, licenses, lines, merkle, pii, quality, secrets, warc
from .textio import scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest_neighbours(vectors, vectors.where(F.col("vec_id") % 100 == 0))


#: Score from which a document counts as good.
GOOD = 0.7


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scores = quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))
    return scores.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.license_scan(table(spark, sf_dir, "documents"))
    starts, labels = F.transform("hits", lambda h: h["start"]), F.transform("hits", lambda h: h["label"])
    return found.select(
        "doc_id", "n_words", F.size("hits").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.concat_ws(",", F.array_sort(F.array_distinct(labels))).alias("base_labels"), F.concat_ws(",", "labels").alias("labels"), "score",
    )


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.pii_spans(table(spark, sf_dir, "documents"))
    base = F.filter("found", lambda s: s["kind"].isin(*pii.BASE))
    return found.select(
        "doc_id", *(count_of(F.col("found"), k).alias(f"n_{k}") for k in pii.BASE), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("found")).alias("spans")
    )


#: A rank file of the public tokenizers, and the pattern that splits texts before its merges.
TOKENIZER = "byte_bpe_multi_50k.tiktoken"


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN, keep_ids=False)


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"), ("url",)).withColumn("n_chars", F.char_length("text").cast("long"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    return warc.read_archives(spark, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secrets.secret_spans(docs, secrets.train(docs))
    base = F.filter("found", lambda s: s["kind"].isin(*secrets.BASE))
    return found.select(
        "doc_id", *(count_of(F.col("found"), k).alias(f"n_{k}") for k in secrets.BASE), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("found")).alias("spans")
    )


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=85)


#: The files of the two tokenizers that are aligned.
BYTES, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"


def op11_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align.alignment_report(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTES), public_tokenizers.PATTERN, public_tokenizers.path(PIECES))


#: Documents whose crc32 is a multiple of this are tampered with before they are checked.
TAMPERED = 7


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string")) % TAMPERED == 0
    leaf = lambda n: merkle.digest_of(F.col("doc_id"), F.col("source"), F.col("lang"), n, F.col("text"))
    leaves = merkle.leaves_of(table(spark, sf_dir, "documents"), F.col("lang"), F.col("doc_id"), leaf(F.col("n_chars")), F.when(tampered, leaf(F.col("n_chars") + 1)))
    _, proofs = merkle.manifest(leaves)
    again = merkle.folded(F.coalesce("again", "digest"), F.col("steps"))
    found = proofs.select(F.col("id").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", "root", merkle.proof_digest(F.col("steps")).alias("proof_sha256"), again.alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lines.judge(docs, lines.train(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op1_decontaminate": op1_decontaminate, "op2_nn_descent": op2_nn_descent, "op3_quality": op3_quality, "op4_licenses": op4_licenses, "op5_pii": op5_pii, "op6_bpe": op6_bpe, "op7_html": op7_html, "op8_warc": op8_warc, "op9_secrets": op9_secrets, "op10_jaccard": op10_jaccard, "op11_align": op11_align, "op12_merkle": op12_merkle, "op13_lines": op13_lines}

OP8_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
k AS (SELECT payload_digest, max(page_id) AS keeper FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes, p.payload_digest,
  CASE WHEN keeper <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN keeper <> page_id THEN keeper END AS refers_to
FROM p LEFT JOIN k USING (payload_digest)
"""

OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
),
g AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 3, least(len(w), 1)))) AS i FROM w)
),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 85 * (x.n + y.n - o)
),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS v, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.v)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT v, min(c) AS c FROM r GROUP BY 1) m ON m.v = d.doc_id
"""

OP12_SQL = """
WITH RECURSIVE v AS (
  SELECT doc_id, lang, n_chars, text, coalesce(octet_length(encode(source)) || ':' || source, '-') || coalesce(octet_length(encode(lang)) || ':' || lang, '-') AS mid FROM documents
),
h AS (
  SELECT doc_id, lang,
    sha256(coalesce(length(doc_id::VARCHAR) || ':' || doc_id, '-') || mid || coalesce(length(n_chars::VARCHAR) || ':' || n_chars, '-') || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
    sha256(coalesce(length(doc_id::VARCHAR) || ':' || doc_id, '-') || mid || coalesce(length((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS altered
  FROM v
),
-- unsigned crc32, eight steps a byte
c AS (
  SELECT DISTINCT doc_id, doc_id::VARCHAR AS s, 0 AS i, 0 AS bit, 4294967295::BIGINT AS x FROM documents WHERE doc_id IS NOT NULL
  UNION ALL
  SELECT doc_id, s, i + (bit = 8)::INT, (bit + 1) % 9,
    CASE WHEN bit = 0 THEN xor(x, ascii(s[i + 1])::BIGINT) WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END
  FROM c WHERE i < length(s)
),
tampered AS (SELECT doc_id FROM c WHERE i = length(s) AND xor(x, 4294967295::BIGINT) % 7 = 0),
l AS (
  SELECT h.*, CASE WHEN t.doc_id IS NULL THEN leaf ELSE altered END AS found, row_number() OVER (PARTITION BY lang ORDER BY h.doc_id NULLS FIRST, leaf) - 1 AS r, count(*) OVER (PARTITION BY lang) AS n
  FROM h LEFT JOIN tampered t ON t.doc_id = h.doc_id
),
t AS (
  SELECT lang, 0 AS lvl, r AS k, leaf AS d, n FROM l
  UNION ALL
  SELECT lang, lvl + 1, k // 2, sha256(d || coalesce(nxt, '')), (n + 1) // 2
  FROM (SELECT *, lead(d) OVER (PARTITION BY lang ORDER BY k) AS nxt FROM t WHERE n > 1) WHERE k % 2 = 0
),
s AS (SELECT lang, d AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS r, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (
  SELECT 0 AS lvl, r AS k, subroot AS d, n FROM s
  UNION ALL
  SELECT lvl + 1, k // 2, sha256(d || coalesce(nxt, '')), (n + 1) // 2 FROM (SELECT *, lead(d) OVER (ORDER BY k) AS nxt FROM u WHERE n > 1) WHERE k % 2 = 0
),
levels AS (SELECT DISTINCT lang, lvl FROM t WHERE n > 1),
steps AS (
  SELECT l.lang, l.r, v.lvl AS seq, t.d, (l.r >> v.lvl) % 2 AS odd
  FROM l JOIN levels v ON v.lang IS NOT DISTINCT FROM l.lang LEFT JOIN t ON t.lang IS NOT DISTINCT FROM l.lang AND t.lvl = v.lvl AND t.k = xor(l.r >> v.lvl, 1)
  UNION ALL
  SELECT l.lang, l.r, 1000 + v.lvl, u.d, (s.r >> v.lvl) % 2
  FROM l JOIN s ON s.lang IS NOT DISTINCT FROM l.lang JOIN (SELECT DISTINCT lvl FROM u WHERE n > 1) v ON true LEFT JOIN u ON u.lvl = v.lvl AND u.k = xor(s.r >> v.lvl, 1)
),
numbered AS (SELECT *, row_number() OVER (PARTITION BY lang, r ORDER BY seq) AS i, count(*) OVER (PARTITION BY lang, r) AS m FROM steps),
f AS (
  SELECT lang, r, 0::BIGINT AS i, found AS acc FROM l
  UNION ALL
  SELECT f.lang, f.r, f.i + 1, sha256(CASE WHEN x.odd = 1 THEN coalesce(x.d, '') ELSE '' END || f.acc || CASE WHEN x.odd = 0 THEN coalesce(x.d, '') ELSE '' END)
  FROM f JOIN numbered x ON x.lang IS NOT DISTINCT FROM f.lang AND x.r = f.r AND x.i = f.i + 1
),
ends AS (SELECT lang, r, arg_max(acc, i) AS folded_root FROM f GROUP BY lang, r),
proof AS (SELECT lang, r, string_agg(coalesce(d, ''), '' ORDER BY seq) AS p FROM steps GROUP BY lang, r)
SELECT l.doc_id, l.leaf, s.subroot, (SELECT d FROM u WHERE n = 1) AS root, sha256(coalesce(p.p, '')) AS proof_sha256, e.folded_root, e.folded_root = (SELECT d FROM u WHERE n = 1) AS verified
FROM l JOIN s ON s.lang IS NOT DISTINCT FROM l.lang JOIN ends e ON e.lang IS NOT DISTINCT FROM l.lang AND e.r = l.r LEFT JOIN proof p ON p.lang IS NOT DISTINCT FROM l.lang AND p.r = l.r
"""

ORACLE_SQL: dict[str, str] = {"op8_warc": OP8_SQL, "op10_jaccard": OP10_SQL, "op12_merkle": OP12_SQL}
