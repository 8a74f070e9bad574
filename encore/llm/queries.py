"""The registered results of the operators, over the whole tables of a folder, and the SQL that some can be checked with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bands, decontam, jaccard, masked_lm, mil, minhash, packing, phrases, resample, separators, shards, votes, warczip, word_lm


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def quality_votes(spark: SparkSession, folder: str) -> DataFrame:
    documents = _table(spark, folder, "documents")
    return votes.quality(documents, votes.train(documents, _table(spark, folder, "labels")))


def masked_scores(spark: SparkSession, folder: str) -> DataFrame:
    documents = _table(spark, folder, "documents")
    return word_lm.score(documents, masked_lm.train(documents))


def decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontam.leak_report(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def sharding(spark: SparkSession, folder: str) -> DataFrame:
    found = shards.assign_shards(_table(spark, folder, "documents"))
    return found.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def warc_packages(spark: SparkSession, folder: str) -> DataFrame:
    return warczip.archive(_table(spark, folder, "pages")).drop("url")


def toxic_sentences(spark: SparkSession, folder: str) -> DataFrame:
    documents = _table(spark, folder, "documents")
    found = mil.toxicity(documents, mil.train(documents, _table(spark, folder, "labels")))
    return found.select("doc_id", "held_out", "score", "predicted", "n_sentences", F.size("offending").cast("long").alias("n_offending"))


def separator_counts(spark: SparkSession, folder: str) -> DataFrame:
    return separators.token_counts(_table(spark, folder, "documents")).select("doc_id", "n_tokens")


def ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.near_duplicates(_table(spark, folder, "documents"))


def best_fit(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(_table(spark, folder, "documents"))


def compression_bands(spark: SparkSession, folder: str) -> DataFrame:
    found = bands.quality_rules(_table(spark, folder, "documents"))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio", "n_chunks", "odd_chunks", "reason"
    )


def importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    return resample.resample(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def minhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, folder, "documents"))


def phrase_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.phrases(_table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_votes": quality_votes,
    "op2_masked_scores": masked_scores,
    "op3_decontamination": decontamination,
    "op4_sharding": sharding,
    "op5_warc_packages": warc_packages,
    "op6_toxic_sentences": toxic_sentences,
    "op7_separator_counts": separator_counts,
    "op8_ngram_join": ngram_join,
    "op9_best_fit": best_fit,
    "op10_compression_bands": compression_bands,
    "op11_importance_resampling": importance_resampling,
    "op12_minhash_dedup": minhash_dedup,
    "op13_phrase_collocations": phrase_collocations,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_BLANK = r"'[^\x20\x09-\x0D]+'"

def _near_sql(percent: int, kept: str = "") -> str:
    """Components of documents whose sets of five-word n-grams are so similar, over all pairs that share an n-gram."""
    return f"""
WITH RECURSIVE doc_words AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, {_BLANK}) AS w FROM documents
), grams AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + least(5, len(w)) - 1], ' ') AS gram
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM doc_words WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id
), shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM grams x JOIN grams y ON x.gram = y.gram AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id
), links AS (
  SELECT s.a, s.b FROM shared s JOIN sizes x ON s.a = x.doc_id JOIN sizes y ON s.b = y.doc_id WHERE 100 * s.k >= {percent} * (x.n + y.n - s.k)
), reach AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION
  SELECT r.doc_id, l.b AS other FROM reach r JOIN links l ON r.other = l.a
)
SELECT d.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, c.component_id{kept}
FROM documents d LEFT JOIN sizes s ON d.doc_id = s.doc_id
JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) c ON d.doc_id = c.doc_id
"""


ORACLE_SQL: dict[str, str] = {
    "op3_decontamination": f"""
WITH item_words AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, {_ALNUM}) AS w FROM benchmark
), item_windows AS (
  SELECT DISTINCT item, least(10, len(w)) AS size, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS win
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item_words WHERE len(w) > 0)
), doc_words AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, {_ALNUM}) AS w FROM documents
), doc_windows AS (
  SELECT doc_id, size, i, array_to_string(w[i : i + size - 1], ' ') AS win
  FROM (
    SELECT doc_id, w, s.size, unnest(range(1, len(w) - s.size + 2)) AS i
    FROM doc_words, (SELECT DISTINCT size FROM item_windows) s WHERE len(w) >= s.size
  )
), found AS (
  SELECT d.doc_id, d.i, d.size, m.item FROM doc_windows d JOIN item_windows m ON d.win = m.win AND d.size = m.size
), hits AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS place FROM found) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(t.names, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM doc_words d LEFT JOIN hits h ON d.doc_id = h.doc_id LEFT JOIN items t ON d.doc_id = t.doc_id
""",
    "op5_warc_packages": f"""
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= {warczip.LEAST_BYTES} GROUP BY payload_digest
)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
  CASE WHEN p.page_id <> f.first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN p.page_id <> f.first_id THEN f.first_id END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest
""",
    "op8_ngram_join": _near_sql(jaccard.PERCENT),
    "op12_minhash_dedup": _near_sql(minhash.Index().percent, ", d.doc_id = c.component_id AS kept"),
    "op11_importance_resampling": f"""
WITH bytes AS (
  SELECT list(CAST(CASE WHEN c % 2 = 1 THEN xor(c >> 1, CAST(3988292384 AS UBIGINT)) ELSE c >> 1 END AS UBIGINT) ORDER BY i) AS steps FROM (
    SELECT i, {"".join("CASE WHEN c % 2 = 1 THEN xor(c >> 1, CAST(3988292384 AS UBIGINT)) ELSE c >> 1 END AS c FROM (SELECT i, " for _ in range(7))}CAST(i AS UBIGINT) AS c
    FROM range(256) x(i){")" * 7})
), words AS (
  SELECT 'd' AS side, doc_id AS id, regexp_extract_all({_LOWER}, {_ALNUM}) AS w FROM documents
  UNION ALL SELECT 'b', item_id, regexp_extract_all({_LOWER}, {_ALNUM}) FROM benchmark
), grams AS (
  SELECT side, id, array_to_string(w[i : i + m - 1], ' ') AS gram
  FROM (SELECT side, id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM words, (SELECT unnest([1, 2, 3]) AS m) WHERE len(w) >= m)
), counted AS (
  SELECT gram, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM grams GROUP BY gram
), hashed AS (
  SELECT gram, s, t, CAST(xor(list_reduce(
    list_prepend(CAST(4294967295 AS UBIGINT), list_transform(regexp_extract_all(hex(encode(gram)), '..'), lambda x: CAST('0x' || x AS UBIGINT))),
    lambda r, b: xor(r >> 8, steps[CAST(xor(r & 255, b) AS BIGINT) + 1])), 4294967295) % 10000 AS BIGINT) AS bucket FROM counted, bytes
), totals AS (
  SELECT bucket, CAST(sum(s) AS DOUBLE) AS s, CAST(sum(t) AS DOUBLE) AS t FROM hashed GROUP BY bucket
), gains AS (
  SELECT bucket, CAST(floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM totals) + 10000) / ((s + 1) * ((SELECT sum(t) FROM totals) + 10000)))) AS BIGINT) AS gain
  FROM totals
), weighed AS (
  SELECT g.id, CAST(count(*) AS BIGINT) AS n, CAST(sum(gain) AS BIGINT) AS weight
  FROM grams g JOIN hashed h ON g.gram = h.gram JOIN gains USING (bucket) WHERE g.side = 'd' GROUP BY g.id
), scored AS (
  SELECT w.id AS doc_id, coalesce(x.n, 0) AS n_features, coalesce(x.weight, 0) AS weight, len(w.w) >= 20 AS able,
    coalesce(x.weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || w.id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM words w LEFT JOIN weighed x ON w.id = x.id WHERE w.side = 'd'
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY able) AS many FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= 5 * many // 100 THEN place END AS rank FROM placed
""",
    "op13_phrase_collocations": rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(string_split_regex({_LOWER}, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM documents
), grams AS (
  SELECT lang, w[i : i + m - 1] AS g FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM pieces, (SELECT unnest([1, 2, 3, 4, 5]) AS m) WHERE len(w) >= m)
), counted AS (
  SELECT lang, g, count(*) AS f FROM grams GROUP BY lang, g
), totals AS (
  SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counted WHERE len(g) = 1 GROUP BY lang
), frequent AS (
  SELECT lang, g, f FROM counted WHERE f >= {phrases.Mining().least}
), cuts AS (
  SELECT c.lang, c.g, c.f AS a, k, x.f AS l, y.f AS r, t.n, CAST((1000::HUGEINT * c.f * t.n) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM (SELECT lang, g, f, unnest(range(1, len(g))) AS k FROM frequent WHERE len(g) > 1) c
  JOIN frequent x ON x.lang = c.lang AND x.g = c.g[1 : k] JOIN frequent y ON y.lang = c.lang AND y.g = c.g[k + 1 :] JOIN totals t ON t.lang = c.lang
), inner_phrases AS (
  SELECT DISTINCT lang, g[i : i + m - 1] AS g, f
  FROM (SELECT lang, g, f, m, unnest(range(1, len(g) - m + 2)) AS i FROM frequent, (SELECT unnest([2, 3, 4]) AS m) WHERE len(g) > m)
), dropped AS (
  SELECT DISTINCT q.lang, q.g FROM frequent q JOIN inner_phrases i ON q.lang = i.lang AND q.g = i.g AND i.f >= q.f
), best AS (
  SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, n, score,
    row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank
  FROM (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1) c
  WHERE NOT EXISTS (SELECT 1 FROM dropped d WHERE d.lang = c.lang AND d.g = c.g)
)
SELECT lang, rank, phrase, a, l, r, n, score FROM best WHERE rank <= {phrases.Mining().top}
""",
}
