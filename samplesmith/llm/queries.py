"""Registered queries of the training-data operators, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from samplesmith.llm import (conversations, decontaminate, langid, lempel_ziv, license_scan, minhash, packing, paragraph_dedup, simhash,
                             spelling, suffix_dedup, token_count, toxicity)
from samplesmith.llm.common import held_out, table

CAPACITY = 1024


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    grammar = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, grammar).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "similarity", "slot_consistency", "reparameterised")


def packed(docs: DataFrame) -> DataFrame:
    """Pieces with digest and place; the ids themselves stay out of the shuffles."""
    pieces = packing.token_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"),
                                  public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, CAPACITY)
    return packing.pack(pieces.withColumn("ids_crc32", F.crc32("tokens")).drop("tokens"), CAPACITY)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_dedup(table(spark, sf_dir, "documents"), shingle=4, max_bits=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = paragraph_dedup.dedup(table(spark, sf_dir, "documents"), short="short_repeats")
    return kept.select("doc_id", F.size("removed_spans").alias("n_removed"), "removed_spans", "short_repeats",
                       F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.learn(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred",
                                                           "score", "languages")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.dedup(table(spark, sf_dir, "documents"), length=200)
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return found.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"),
                        F.sha2("kept", 256).alias("kept_sha256"))


def op9_lempel_ziv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lempel_ziv.fingerprints(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = token_count.sentencepiece_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    return token_count.token_counts(table(spark, sf_dir, "documents"), vocabulary)


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_dedup(table(spark, sf_dir, "documents"), shingle=3, percent=85)


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.damaged_repair(table(spark, sf_dir, "conversations"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"), min_length=6, min_count=5, ratio=5)


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_decontamination, op3_packing, op4_license_scan, op5_simhash,
                                   op6_paragraph_dedup, op7_language, op8_suffix_dedup, op9_lempel_ziv, op10_token_counts,
                                   op11_minhash, op12_conversations, op13_spelling)}

#: Template windows as lists instead of hashes, and all joins spelled out.  RE2 has no look-around, so a unit's
#: neighbours are captured; every word is a run of letters and numbers, so both forms find the same units.
DECONTAMINATION_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, text
              FROM (SELECT DISTINCT CAST(doc_id AS BIGINT) AS doc_id, text FROM documents)),
texts AS (
  SELECT r, NULL AS item_id, text FROM docs
  UNION ALL SELECT NULL AS r, item_id, text FROM benchmark),
plain AS (
  SELECT r, item_id, trim(regexp_replace(coalesce(text, ''), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS p FROM texts),
named AS (
  SELECT r, item_id, p, regexp_replace(lower(regexp_replace(p, '(^| )\\p{{Lu}}[^ ]*', '\\1<name>', 'g')),
                                       '(^| )\\p{{N}}[^ ]*', '\\1<num>', 'g') AS t FROM plain WHERE p <> ''),
words AS (
  SELECT r, item_id, string_split(p, ' ') AS w,
         string_split(regexp_replace(t, '(<num> )(?:{"|".join(decontaminate.UNITS)})( |$)', '\\1<unit>\\2', 'g'), ' ') AS c
  FROM named),
places AS (SELECT *, unnest(range(1, greatest(len(c) - 3, 2))) AS i FROM words),
windows AS (
  SELECT r, item_id, c[i:i + 4] AS h,
         list_filter(list_transform(range(i, least(i + 5, len(c) + 1)), lambda j: CASE WHEN starts_with(c[j], '<') THEN w[j] END),
                     lambda x: x IS NOT NULL) AS slots
  FROM places),
items AS (SELECT DISTINCT item_id, h, slots FROM windows WHERE r IS NULL),
sizes AS (SELECT item_id, count(DISTINCT h) AS n_windows FROM items GROUP BY 1),
asked AS (SELECT DISTINCT item_id, h FROM items),
given AS (SELECT r, h, slots FROM windows WHERE r IS NOT NULL),
found AS (
  SELECT r, item_id, count(*) AS n_found
  FROM (SELECT DISTINCT g.r, a.item_id, g.h FROM given g JOIN asked a ON a.h = g.h) GROUP BY 1, 2),
enough AS (
  SELECT f.r, f.item_id, f.n_found / s.n_windows AS similarity FROM found f JOIN sizes s ON s.item_id IS NOT DISTINCT FROM f.item_id
  WHERE f.n_found / s.n_windows >= 0.8),
pairs AS (
  SELECT r, item_id, iv, dv, count(*) AS n
  FROM (SELECT e.r, e.item_id, unnest(i.slots) AS iv, unnest(g.slots) AS dv
        FROM enough e JOIN given g ON g.r = e.r JOIN items i ON i.h = g.h AND i.item_id IS NOT DISTINCT FROM e.item_id)
  GROUP BY 1, 2, 3, 4),
sides AS (
  SELECT r, item_id, 'item' AS side, max(n) AS most, sum(n) AS total, max(iv <> dv) AS differs FROM pairs GROUP BY r, item_id, iv
  UNION ALL
  SELECT r, item_id, 'document', max(n), sum(n), max(iv <> dv) FROM pairs GROUP BY r, item_id, dv),
agree AS (
  SELECT r, item_id, min(agree) AS agree, bool_or(differs) AS differs
  FROM (SELECT r, item_id, side, sum(most) / sum(total) AS agree, max(differs) AS differs FROM sides GROUP BY r, item_id, side)
  GROUP BY 1, 2)
SELECT d.doc_id, e.item_id, e.similarity, coalesce(a.agree, 1.0) AS slot_consistency, coalesce(a.differs, false) AS reparameterised
FROM enough e JOIN docs d ON d.r = e.r LEFT JOIN agree a ON a.r = e.r AND a.item_id IS NOT DISTINCT FROM e.item_id
WHERE coalesce(a.agree, 1.0) >= 0.9
"""
ORACLE = {"op2_decontamination": DECONTAMINATION_SQL}
