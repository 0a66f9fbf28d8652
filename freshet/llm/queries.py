"""The operators' named queries, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracle
from .chat_format import format_preferences, stale_reply_pairs
from .common import scratch, sent_if_small, table
from .decontaminate import contamination, words_of
from .line_dedup import cut_lines, repeated_lines
from .packing import pack_documents
from .pii import personal_data
from .quality import judge_once
from .sharding import shard_documents
from .simhash import near_duplicates
from .suffix_dedup import remove_repeats
from .token_store import read_tokens, write_tokens


def tokenizer_file(name: str) -> str:
    """Where a public vocabulary file lies on this machine; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path, tokenizer_file("byte_bpe_50k.json"))
    return read_tokens(spark, path)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_documents(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_once(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return judged.select("_row.doc_id", *[f"quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), distance=4, width=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    formatted = format_preferences(stale_reply_pairs(table(spark, sf_dir, "conversations")))
    spans = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws("-", x["begin"].cast("string"), x["end"].cast("string"))), ",")
    return formatted.withColumn("chosen_mask", spans("chosen_mask")).withColumn("rejected_mask", spans("rejected_mask"))


_RENDER = "coalesce(array_to_string(list_transform({0}, lambda t: '<|' || coalesce(t.role, '') || '|>' || chr(10) || coalesce(t.text, '') || '<|end|>' || chr(10)), ''), '')"
_MASK = """coalesce(array_to_string(list_filter(list_transform(range(1, len({0}) + 1), lambda i: CASE WHEN {0}[i].role = 'assistant' THEN
  (coalesce(list_sum(list_transform({0}[1:i-1], lambda t: length(coalesce(t.role, '')) + length(coalesce(t.text, '')) + 13)), 0) + length({0}[i].role) + 5)::BIGINT || '-' ||
  list_sum(list_transform({0}[1:i], lambda t: length(coalesce(t.role, '')) + length(coalesce(t.text, '')) + 13))::BIGINT END), lambda x: x IS NOT NULL), ','), '')"""
OP2_SQL = f"""WITH c AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn, role, text) AS turns FROM conversations GROUP BY conv_id),
r AS (SELECT *, list_filter(range(1, len(turns) + 1), lambda i: turns[i].role = 'assistant') AS spots FROM c),
q AS (SELECT *, coalesce(conv_id, 0) % greatest(len(spots), 1) AS m FROM r),
j AS (SELECT *, CASE WHEN m < 0 THEN m + len(spots) ELSE m END + 1 AS j FROM q),
p AS (SELECT conv_id AS pair_id, turns AS a, CASE WHEN len(spots) = 0 THEN turns
  ELSE list_append(turns[1:spots[j] - 1], {{'role': 'assistant', 'text': CASE WHEN j > 1 THEN coalesce(turns[spots[j - 1]].text, '') ELSE '' END}}) END AS b FROM j),
n AS (SELECT *, coalesce(list_min(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[i] IS DISTINCT FROM b[i])) - 1, least(len(a), len(b))) AS k FROM p),
x AS (SELECT pair_id, k, a[1:k] AS pre, a[k + 1:] AS ra, b[k + 1:] AS rb FROM n)
SELECT pair_id, k::INTEGER AS n_prompt_turns, {_RENDER.format("pre")} AS prompt, {_RENDER.format("ra")} AS chosen, {_RENDER.format("rb")} AS rejected,
{_MASK.format("ra")} AS chosen_mask, {_MASK.format("rb")} AS rejected_mask FROM x"""


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    hits = contamination(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), "item_ids", "near_ids", "n_hit")
    sizes = docs.select("doc_id", F.xxhash64("text").alias("mark"), F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    items = F.coalesce("item_ids", F.array().cast("array<string>"))
    return sizes.join(sent_if_small(hits), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark")), "left").select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
        F.coalesce(F.size("near_ids"), F.lit(0)).cast("long").alias("n_near_items"),
    )


def op5_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["begin"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", *[count(k) for k in ("email", "ip", "card", "phone")], F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return cut_lines(docs, repeated_lines(docs)).select("_row.doc_id", F.size("lines").cast("long").alias("n_lines"), F.size("removed").cast("long").alias("n_removed"), F.sha2("text", 256).alias("kept_sha256"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {
    "op9_suffix_dedup": op9_suffix_dedup,
    "op1_benchmark_decontamination": op1_benchmark_decontamination,
    "op5_pii_crf": op5_pii_crf,
    "op7_line_dedup": op7_line_dedup,
    "op2_chat_format": op2_chat_format,
    "op4_simhash_near_dedup": op4_simhash_near_dedup,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op6_token_store": op6_token_store,
    "op8_sharding": op8_sharding,
    "op10_quality_rules": op10_quality_rules,
}
SQL: dict[str, str] = {"op2_chat_format": OP2_SQL, **oracle.SQL}
