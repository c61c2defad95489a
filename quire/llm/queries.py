"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import bpe, embed_dedup, hard_negatives, langid, license_scan, minhash_dedup, mixing, packing, quality, spelling, spotsigs, suffix_dedup, token_count


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), threshold=0.98)


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash_dedup.near_duplicates(_docs(spark, sf_dir), words=5, percent=85)
    return found.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level tokens: a text's UTF-8 bytes and one end mark each."""
    return packing.pack_documents(_docs(spark, sf_dir), F.coalesce(F.octet_length("text"), F.lit(0)) + 1)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).select("doc_id", "text")
    model = quality.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality.score_quality(docs, model)
    return scored.select("doc_id", langid.held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_count.token_counts(_docs(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 4096)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(_docs(spark, sf_dir)).drop("detections")


def op8_spotsigs_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.edited_and_next(_docs(spark, sf_dir))


def spotsigs_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other half of op8: the smallest doc_id whose fingerprint is reached by links of a likeness of 0.8 or more, by the join on
    partitions of lengths. It is a query of its own as its tables take more disk than op8 has."""
    return spotsigs.similar_classes(spotsigs.spot_signatures(_docs(spark, sf_dir)))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_documents(_docs(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), "decoded_sha256")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    model = langid.fit_languages(docs)
    return langid.identify(docs.select("doc_id", "text"), model).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "ambiguous")


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With n_kept and text: the number of bytes left, and these as text (U+FFFD for characters that are cut)."""
    cut = suffix_dedup.remove_repeats(_docs(spark, sf_dir), length=400)
    return cut.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"),
        F.size("repeat_spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
        F.length("kept").cast("long").alias("n_kept"), F.make_valid_utf8(F.col("kept").cast("string")).alias("text"),
    )


def op11_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the number of copies that the mix has of a document."""
    mixed = mixing.mix_counts(_docs(spark, sf_dir))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh label is one too high, so that some near rows count as negatives."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumn("label", moved), "vec_id % 100 = 0")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run in 97 has lost a letter, so that there are variants to be found."""
    return spelling.spelling_groups(_docs(spark, sf_dir), slips=spelling.SLIP)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_embedding_near_dedup, op2_minhash_near_dedup, op3_best_fit_packing, op4_quality_classifier, op5_suffix_array_dedup,
        op6_token_counts, op7_license_scan, op8_spotsigs_fingerprints, op9_byte_bpe, op10_language_id, op11_source_mixing, op12_hard_negatives, op13_spelling_variants,
        spotsigs_classes,
    )
}

#: Where SQL can express a query's result.
ORACLE_SQL: dict[str, str] = {
    "op1_embedding_near_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), pairs AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_inner_product(a.e, b.e) / sqrt(list_inner_product(a.e, a.e) * list_inner_product(b.e, b.e)) >= 0.98
), reach(x, y) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT r.x, p.y FROM reach r JOIN pairs p ON p.x = r.y
)
SELECT v.vec_id, (SELECT count(*) FROM pairs p WHERE p.x = v.vec_id) AS n_links, c.component_id, c.component_id = v.vec_id AS kept
FROM v JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY x) c ON c.x = v.vec_id
""",
    "op2_minhash_near_dedup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(1, len(ws) - 4))) AS i FROM w WHERE len(ws) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), pairs AS (
  SELECT x, y FROM shared JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 85 * (p.n + q.n - k)
), reach(x, y) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.x, p.y FROM reach r JOIN pairs p ON p.x = r.y
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, c.component_id = d.doc_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY x) c ON c.x = d.doc_id
""",
    "op11_source_mixing": r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 13) AS BIGINT) / 4503599627370496.0 :: DOUBLE AS draw
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] :: DOUBLE AS w FROM d GROUP BY source
), filled AS (
  SELECT sum(source_size) OVER () - 3 * sum(source_size) OVER o AS share, sum(w) OVER () - sum(w) OVER o AS weight
  FROM s WINDOW o AS (ORDER BY source_size / w, source ROWS UNBOUNDED PRECEDING)
  UNION ALL SELECT sum(source_size), sum(w) FROM s
), level AS (
  SELECT CAST(share AS DOUBLE) AS share, weight FROM filled WHERE weight > 0 ORDER BY share / weight DESC LIMIT 1
), t AS (
  SELECT source, source_size, least(3.0 :: DOUBLE * source_size, w * share / weight) AS target FROM s, level
), r AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(3.0 :: DOUBLE, target / source_size) ELSE 0.0 END AS rate FROM t
)
SELECT doc_id, size, source_size, target, size * n AS taken, n AS copies
FROM (SELECT d.*, r.source_size, r.target, CAST(floor(rate) AS BIGINT) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END AS n FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
""",
    "op12_hard_negatives": """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS s
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
), p AS (
  SELECT a, b, s FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5
)
SELECT p.a AS anchor_id, p.b AS positive_id, CAST(row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.s DESC, n.b) AS INTEGER) AS rank,
  n.b AS negative_id, p.s AS positive_score, n.s AS negative_score
FROM p JOIN s n ON n.a = p.a AND NOT n.same AND 30 * p.s <= 100 * n.s AND 100 * n.s <= 90 * p.s
QUALIFY rank <= 10
""",
    "op13_spelling_variants": r"""
WITH RECURSIVE byte(i, c, k) AS (
  SELECT i, i, 0 FROM generate_series(0, 255) t(i)
  UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM byte WHERE k < 8
), crc AS (
  SELECT list(c ORDER BY i) AS t FROM byte WHERE k = 8
), runs AS (
  SELECT doc_id, w, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS w FROM documents)
  WHERE length(w) >= 5 GROUP BY ALL
), hashed AS (
  SELECT w, n, xor(list_reduce(
    list_prepend(4294967295 :: BIGINT, list_transform(generate_series(1, length(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i - 1, 2) AS BIGINT))),
    lambda h, b: xor(h // 256, t[1 + xor(h % 256, b)])), 4294967295) AS h
  FROM (SELECT w, n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w)) AS x FROM runs), crc
), words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n
  FROM (SELECT n, CASE WHEN h % 97 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), less AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS x FROM (SELECT word, n, unnest(generate_series(1, length(word))) AS i FROM words)
), longer AS (
  SELECT DISTINCT w.word, l.word AS other, w.n, l.n AS m FROM words w JOIN less l ON l.x = w.word
), near AS (
  SELECT a.word, b.word AS other, b.n AS m FROM less a JOIN less b ON a.i = b.i AND a.x = b.x AND a.word <> b.word
  UNION ALL SELECT word, other, m FROM longer UNION ALL SELECT other, word, n FROM longer
), best AS (
  SELECT word, count(*) OVER (PARTITION BY word) AS n_near, other, m FROM near QUALIFY row_number() OVER (PARTITION BY word ORDER BY m DESC, other) = 1
), known AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * w.n THEN other END AS form, CASE WHEN m >= 2 * w.n THEN m END AS form_n
  FROM words w LEFT JOIN best b ON b.word = w.word
), chain(word, root, k) AS (
  SELECT word, word, 0 FROM known UNION ALL SELECT c.word, k.form, c.k + 1 FROM chain c JOIN known k ON k.word = c.root WHERE k.form IS NOT NULL
)
SELECT k.word, k.n, k.n_near, k.form, k.form_n, c.root FROM known k JOIN (SELECT word, arg_max(root, k) AS root FROM chain GROUP BY word) c ON c.word = k.word
""",
}
