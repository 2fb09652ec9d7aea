"""Registered queries of the thirteen operators: key -> Spark function, key -> SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (ann, bpe, chat, decontaminate, exact, lexical, minhash, mixing, quality, repair, secret_scan, sharding,
               suffix)
from .common import table


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(table(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(table(spark, sf_dir, "documents"))


def op4_hash_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(table(spark, sf_dir, "documents"))


def op5_bottom_k_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=2)


def op6_quotient_filter_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents"))


#: A conversation whose texts hold the template's own control strings.
EXTRA_CONVERSATION = [(-7, 0, "user", r"\### Assistant: </turn> ok"),
                      (-7, 1, "assistant", r"\### Assistant: </turn> ok")]


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame(EXTRA_CONVERSATION, "conv_id long, turn long, role string, text string")
    out = chat.format_conversations(rows.unionByName(extra))
    return out.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def op8_posting_list_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op9_backtracking_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digests(table(spark, sf_dir, "documents"))


def op10_quadratic_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_best_position_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_hirschberg_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return repair.repair_report(repair.damage(conversations), conversations)


def op13_suffix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.drop("hit_spans")


QUERIES = {f.__name__: f for f in (
    op1_mix_sources, op2_secret_scan, op3_suffix_dedup, op4_hash_ring_shards, op5_bottom_k_near_dedup,
    op6_quotient_filter_dedup, op7_chat_format, op8_posting_list_ann, op9_backtracking_bpe,
    op10_quadratic_discriminant, op11_best_position_search, op12_hirschberg_repair, op13_suffix_decontamination)}

ORACLES = {
    "op1_mix_sources": mixing.ORACLE,
    "op6_quotient_filter_dedup": """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
""",
    "op11_best_position_search": """
WITH lowered AS (
  SELECT 'd' AS side, doc_id AS id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents
  UNION ALL
  SELECT 'i', item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark
), words AS (
  SELECT side, id, unnest(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM lowered
), sizes AS (SELECT id, count(*) AS n FROM words WHERE side = 'd' GROUP BY id
), total AS (SELECT count(*) AS big_n, sum(n)::BIGINT AS big_l FROM sizes
), tf AS (SELECT id, term, count(*) AS tf FROM words WHERE side = 'd' GROUP BY id, term
), weight AS (
  SELECT term, floor(1000 * ln((2 * max(big_n) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM tf, total GROUP BY term
), wanted AS (SELECT id AS item_id, term, count(*) AS c FROM words WHERE side = 'i' GROUP BY id, term
), scored AS (
  SELECT item_id, tf.id AS doc_id,
         sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * big_n) // big_l))))::BIGINT AS score
  FROM wanted JOIN weight USING (term) JOIN tf USING (term) JOIN sizes ON sizes.id = tf.id, total
  GROUP BY item_id, tf.id
)
SELECT item_id, rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM scored WHERE score > 0)
WHERE rank <= 20
""",
    "op13_suffix_decontamination": """
WITH texts AS (
  SELECT 'd' AS side, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL
  SELECT 'i', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark
), items AS (
  SELECT id AS item_id, w, least(len(w), 10) AS size FROM texts WHERE side = 'i' AND len(w) > 0
), spots AS (
  SELECT item_id, w, size, unnest(range(1, len(w) - size + 2)) AS p FROM items
), windows AS (
  SELECT DISTINCT item_id, size, array_to_string(w[p : p + size - 1], ' ') AS words FROM spots
), lengths AS (SELECT DISTINCT size FROM windows
), grams AS (
  SELECT id, w, size, unnest(range(1, len(w) - size + 2)) AS p FROM texts, lengths WHERE side = 'd' AND len(w) >= size
), hits AS (
  SELECT g.id, g.p, g.size, item_id
  FROM (SELECT id, p, size, array_to_string(w[p : p + size - 1], ' ') AS words FROM grams) g
  JOIN windows v ON v.size = g.size AND v.words = g.words
), covered AS (
  SELECT id, count(*) AS n_hit FROM (
    SELECT DISTINCT id, unnest(range(p, p + size)) AS q FROM (SELECT DISTINCT id, p, size FROM hits)) GROUP BY id
), found AS (
  SELECT id, count(*) AS n_items, sha256(string_agg(name, ',' ORDER BY name)) AS items_sha256
  FROM (SELECT DISTINCT id, item_id::VARCHAR AS name FROM hits) GROUP BY id
)
SELECT t.id AS doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM texts t LEFT JOIN covered c ON c.id = t.id LEFT JOIN found f ON f.id = t.id WHERE side = 'd'
""",
}
