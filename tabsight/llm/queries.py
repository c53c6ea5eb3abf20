"""Registered queries of the training-data operators and their DuckDB twins."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsight.llm import fingerprints, html_text, line_dedup, merkle, mixing, pivot_index, pst_lm, quality_cnn, sharding, simhash_trie, sp_tokens, suffix_dedup, whitening
from tabsight.session import read_table

SHINGLE, MAX_BITS = 4, 4
#: A public SentencePiece model; the path is a parameter of the operator.
PIECES = os.environ.get("PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and their edited texts."""
    return fingerprints.document_fingerprints(read_table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line dedup over all documents: what is left of each text."""
    left = line_dedup.line_dedup(read_table(spark, sf_dir, "documents"), count="n_removed")
    return left.select("doc_id", "n_removed", F.char_length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality classifier over all documents."""
    return quality_cnn.score_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixing sources to target weights over all documents."""
    return mixing.mix_plan(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_pivot_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedding near-dedup of all vectors at cosine 0.98."""
    return pivot_index.embedding_components(read_table(spark, sf_dir, "embeddings"), 0.98)


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SentencePiece ids of all documents and the texts decoded from them, as digests."""
    return sp_tokens.round_trip(read_table(spark, sf_dir, "documents"), PIECES)


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible text of all pages, as digests."""
    pages = html_text.extract_pages(read_table(spark, sf_dir, "pages"))
    lines = F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", "\n", -1)))
    return pages.select("page_id", "url", F.char_length("text").cast("long").alias("n_chars"), lines.cast("long").alias("n_lines"),
                        F.sha2("text", 256).alias("text_sha256"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suffix-array dedup of all documents at 400 bytes."""
    left = suffix_dedup.dedup_substrings(read_table(spark, sf_dir, "documents"), 400)
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"),
                       (F.col("n_bytes") - F.col("n_removed")).alias("n_kept"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash near-dedup over all documents."""
    found = simhash_trie.simhash_components(read_table(spark, sf_dir, "documents"), SHINGLE, MAX_BITS)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LM scoring by a probabilistic suffix tree over all documents."""
    return pst_lm.lm_scores(read_table(spark, sf_dir, "documents"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle manifest of all documents with proofs, checked against texts in lower case for every fifth id hash."""
    docs = read_table(spark, sf_dir, "documents")
    found = merkle.record_digest([merkle.ascii_lower(F.col(c)) if c == "text" else F.col(c) for c in merkle.FIELDS])
    altered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, found)
    return merkle.audit(merkle.build_manifest(docs, altered=altered)).withColumnRenamed("key", "doc_id")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened embeddings, one row per vector and component."""
    white = whitening.whiten(read_table(spark, sf_dir, "embeddings"))
    rows = white.select(F.col("key").alias("vec_id"), "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("z", "explained")))
    return rows.select("vec_id", (F.col("pos") + 1).alias("component"), "n", "deviation", F.col("col.z").alias("whitened"),
                       F.col("col.explained").alias("explained"), "identity_error")


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document, shards near equal in bytes."""
    placed = sharding.assign_shards(read_table(spark, sf_dir, "documents"))
    return placed.select(F.col("key").alias("doc_id"), "size", "text_crc32", F.lit(sharding.LAW).alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {f.__name__: f for f in (
    op1_fingerprints, op2_line_dedup, op3_quality, op4_mixing, op5_pivot_index, op6_sentencepiece, op7_html_extraction,
    op8_suffix_dedup, op9_simhash, op10_lm_scores, op11_merkle, op12_whitening, op13_sharding)}

OP4_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT source, source_size,
         [5, 2, 1][1 + (row_number() OVER (ORDER BY source IS NULL, source COLLATE C) - 1) % 3] AS weight FROM s
), r AS (
  SELECT *, sum(source_size) OVER () AS total,
         coalesce(sum(source_size * 3) OVER (ORDER BY source_size * 3.0 / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held,
         sum(weight) OVER (ORDER BY source_size * 3.0 / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_w FROM w
), l AS (
  SELECT arg_min(CAST(total - held AS DOUBLE) / CAST(open_w AS DOUBLE), source_size * 3.0 / weight) AS level FROM r
  WHERE CAST(total - held AS DOUBLE) / CAST(open_w AS DOUBLE) * weight <= source_size * 3
), t AS (
  SELECT source, source_size, least(weight * (SELECT level FROM l), CAST(source_size * 3 AS DOUBLE)) AS target FROM w
), q AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CAST(size * (floor(rate) + CASE WHEN CAST(('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13)) AS BIGINT)
            / 4503599627370496.0 < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM q
"""

OP5_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), e AS (
  SELECT a.vec_id AS src, b.vec_id AS dst FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98
), r AS (
  SELECT vec_id, vec_id AS m FROM embeddings UNION SELECT r.vec_id, e.dst FROM r JOIN e ON r.m = e.src
), c AS (
  SELECT vec_id, min(m) AS component_id FROM r GROUP BY vec_id
), n AS (
  SELECT src, count(*) AS n FROM e GROUP BY src
)
SELECT c.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.component_id, c.vec_id = c.component_id AS kept
FROM c LEFT JOIN n ON c.vec_id = n.src
"""

OP11_SQL = r"""
WITH RECURSIVE tab AS (
  SELECT list(v ORDER BY n) AS t FROM (
    SELECT n, list_reduce([n] || range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v
    FROM (SELECT CAST(range AS BIGINT) AS n FROM range(256)))
), d AS (
  SELECT doc_id, source, 'r' || row_number() OVER () AS id, text,
         coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
         || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head,
         4294967295 - list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: CAST(ord(ch) AS BIGINT)),
                                  lambda c, b: xor(c // 256, tab.t[1 + (xor(c, b) & 255)])) AS crc
  FROM documents, tab
), l AS (
  SELECT id, doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         CASE WHEN crc % 5 = 0 THEN sha256(head || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS altered
  FROM d
), p AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM l
), t AS (
  SELECT source, 0 AS lev, i, leaf AS h, n FROM p
  UNION ALL
  SELECT source, lev + 1, i // 16, sha256(string_agg(h, '' ORDER BY i)), (n + 15) // 16 FROM t WHERE n > 1 GROUP BY source, lev, i // 16, n
), s AS (
  SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1
), u AS (
  SELECT 0 AS lev, i, subroot AS h, n FROM s
  UNION ALL
  SELECT lev + 1, i // 16, sha256(string_agg(h, '' ORDER BY i)), (n + 15) // 16 FROM u WHERE n > 1 GROUP BY lev, i // 16, n
), f AS (
  SELECT id, source, 0 AS lev, i, coalesce(altered, leaf) AS cur, '' AS proof, n FROM p
  UNION ALL
  SELECT f.id, f.source, f.lev + 1, f.i // 16, sha256(string_agg(CASE WHEN t.i = f.i THEN f.cur ELSE t.h END, '' ORDER BY t.i)),
         f.proof || coalesce(string_agg(CASE WHEN t.i <> f.i THEN t.h END, '' ORDER BY t.i), ''), (f.n + 15) // 16
  FROM f JOIN t ON t.source IS NOT DISTINCT FROM f.source AND t.lev = f.lev AND t.i // 16 = f.i // 16
  WHERE f.n > 1 GROUP BY f.id, f.source, f.lev, f.i, f.proof, f.n
), g AS (
  SELECT f.id, 0 AS lev, s.i, f.cur, f.proof, s.n FROM f JOIN s ON s.source IS NOT DISTINCT FROM f.source WHERE f.n = 1
  UNION ALL
  SELECT g.id, g.lev + 1, g.i // 16, sha256(string_agg(CASE WHEN u.i = g.i THEN g.cur ELSE u.h END, '' ORDER BY u.i)),
         g.proof || coalesce(string_agg(CASE WHEN u.i <> g.i THEN u.h END, '' ORDER BY u.i), ''), (g.n + 15) // 16
  FROM g JOIN u ON u.lev = g.lev AND u.i // 16 = g.i // 16
  WHERE g.n > 1 GROUP BY g.id, g.lev, g.i, g.proof, g.n
)
SELECT p.doc_id, p.leaf, s.subroot, r.h AS root, sha256(g.proof) AS proof_sha256, g.cur AS folded_root, g.cur = r.h AS verified
FROM p JOIN g ON g.id = p.id AND g.n = 1 JOIN s ON s.source IS NOT DISTINCT FROM p.source, (SELECT h FROM u WHERE n = 1) r
"""

ORACLE_SQL = {"op4_mixing": OP4_SQL, "op5_pivot_index": OP5_SQL, "op11_merkle": OP11_SQL}
