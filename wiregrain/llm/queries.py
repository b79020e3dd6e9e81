"""Registered queries of the corpus operators, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wiregrain.llm import archives, backoff, countjoin, disclosure, divergence, language, quality, segmentation, simhash, spans, templates, tokens, whitening
from wiregrain.session import Scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _register(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[query.__name__] = query
    return query


def tokenizer_file(name: str) -> str:
    """Place of a public vocabulary file on this machine; executors have it at the same place."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


@_register
def op1_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document, learned from the two thirds that are not held out."""
    docs = _documents(spark, folder)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    model = language.fit(docs.filter(F.crc32(F.col("doc_id").cast("string")) % 3 != 1))
    return language.predict(docs, model).withColumn("held_out", held_out).select("doc_id", "held_out", "lang_pred", "score")


@_register
def op2_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    """Two segmentations of every document, sampled without replacement."""
    return segmentation.encode(_documents(spark, folder), tokenizer_file("piece_bpe_32k.model"), k=2)


@_register
def op3_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Words that stay in every document when windows of 20 words that occur earlier are removed."""
    found = spans.drop_repeats(_documents(spark, folder), texts=False)
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


@_register
def op4_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Rules and n-gram verdict of every document; texts labelled good and not toxic are the trusted part."""
    docs, labels = _documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet")
    ratios = quality.log_ratios(quality.with_trusted(docs, labels.filter("quality = 1 and toxic = 0")))
    return quality.judge(docs, ratios).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("score", 6).alias("score")
    )


@_register
def op5_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes and byte-level BPE tokens of every document."""
    return tokens.token_counts(_documents(spark, folder), tokenizer_file("byte_bpe_50k.json"))


@_register
def op6_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    """Stupid-backoff score of every document under the n-grams of all others."""
    return backoff.score(_documents(spark, folder), Scratch(spark))


@_register
def op7_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold a benchmark item, as it is or with other numbers, names or units."""
    items = spark.read.parquet(f"{folder}/benchmark.parquet")
    return templates.contaminated(_documents(spark, folder), items).select("doc_id", "item_id", "covered", "changed")


@_register
def op8_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Every page as a WARC record, read back, with its place in the merged index."""
    found = archives.capture_histories(spark.read.parquet(f"{folder}/pages.parquet"), Scratch(spark))
    return found.select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "history_range", "history_position"
    )


@_register
def op9_pii(spark: SparkSession, folder: str) -> DataFrame:
    """Identifiers in every document, and all places of the terms that give them away."""
    return disclosure.personal_data(_documents(spark, folder), Scratch(spark))


@_register
def op10_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.near_duplicates(_documents(spark, folder), Scratch(spark))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


@_register
def op13_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    """Component of every document under links of word 4-gram sets with a Jaccard similarity of 0.85 or more."""
    return countjoin.jaccard_groups(_documents(spark, folder), Scratch(spark))


@_register
def op11_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """Four whitened components of every embedding."""
    return whitening.whiten(spark.read.parquet(f"{folder}/embeddings.parquet"), Scratch(spark))


@_register
def op12_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    """Differences of the sources of each language, and the terms that set a source apart."""
    return divergence.audit(_documents(spark, folder), Scratch(spark))


ORACLES["op12_source_divergence"] = r"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents),
kept AS (
  SELECT lang, term FROM (SELECT lang, unnest(list_distinct(words)) AS term FROM d) GROUP BY lang, term HAVING count(*) >= 10),
size AS (SELECT g.lang, g.source, coalesce(k.v, 0) AS v
  FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN (SELECT lang, count(*) AS v FROM kept GROUP BY lang) k USING (lang)),
seen AS (
  SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(words) AS term FROM d) JOIN kept USING (lang, term)
  GROUP BY lang, source, term),
dense AS (
  SELECT s.lang, s.source, k.term, s.v, coalesce(c.n, 0) AS n FROM size s JOIN kept k USING (lang) LEFT JOIN seen c USING (lang, source, term)),
own AS (
  SELECT lang, source, term, n,
         1 + (1000000000 * (n + 2)) // (CAST(sum(n) OVER (PARTITION BY lang, source) AS BIGINT) + 2 * v) AS p
  FROM dense),
whole AS (
  SELECT lang, term, 1 + (1000000000 * (n + 2)) // (CAST(sum(n) OVER (PARTITION BY lang) AS BIGINT) + 2 * v) AS q
  FROM (SELECT lang, term, CAST(sum(n) AS BIGINT) AS n, any_value(v) AS v FROM dense GROUP BY lang, term)),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value
  FROM size a JOIN size b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (
    SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) AS value
    FROM own x JOIN own y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY 1, 2, 3) f
  ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (
  SELECT lang, source, term AS item, CAST(((p - q) * (p - q)) // (p + q) AS BIGINT) AS value
  FROM own JOIN whole USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL
  SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM terms)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
