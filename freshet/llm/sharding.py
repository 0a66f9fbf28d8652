"""Exact-size uniform sharding by a hypergeometric communication matrix."""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settled

#: Rows that one source bucket or one slot bucket holds on average; a sort inside a bucket is one task's work.
BUCKET_ROWS = 50_000
#: Source buckets at least, so that small tables are spread too, and at most, so that the driver draws a bounded number of
#: counts: beyond 3 * 10**9 rows the buckets grow instead.
LEAST_BUCKETS, MOST_BUCKETS = 64, 65_536


def hypergeometric(rng: random.Random, total: int, marked: int, drawn: int) -> int:
    """How many of ``drawn`` items, taken without replacement from ``total``, are among the ``marked`` ones.

    Inversion outwards from the mode, so the work follows the standard deviation and not the counts.
    """
    low, high = max(0, drawn - (total - marked)), min(marked, drawn)
    if low == high:
        return low
    mode = min(max((drawn + 1) * (marked + 1) // (total + 2), low), high)

    def log_choose(n: int, k: int) -> float:
        return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)

    at_mode = math.exp(log_choose(marked, mode) + log_choose(total - marked, drawn - mode) - log_choose(total, drawn))
    left = rng.random() - at_mode
    down, up, p_down, p_up = mode, mode, at_mode, at_mode
    while left > 0:
        moved = False
        if up < high:
            p_up *= (marked - up) * (drawn - up) / ((up + 1) * (total - marked - drawn + up + 1))
            up, left, moved = up + 1, left - p_up, True
            if left <= 0:
                return up
        if down > low:
            p_down *= down * (total - marked - drawn + down) / ((marked - down + 1) * (drawn - down + 1))
            down, left, moved = down - 1, left - p_down, True
            if left <= 0:
                return down
        if not moved or max(p_up if up < high else 0, p_down if down > low else 0) < 1e-300:
            return mode  # what rounding has left over
    return mode


def communication_matrix(counts: list[int], sizes: list[int], seed: int) -> list[list[int]]:
    """Rows that each source bucket sends to each shard: row sums are ``counts``, column sums ``sizes``.

    It has the law of a uniformly random assignment with these margins (multivariate hypergeometric, row by row).
    """
    rng, open_slots, matrix = random.Random(seed), list(sizes), []
    for count in counts:
        total, left, row = sum(open_slots), count, []
        for free in open_slots:
            sent = hypergeometric(rng, total, free, left)
            row.append(sent)
            total, left = total - free, left - sent
        open_slots = [free - sent for free, sent in zip(open_slots, row, strict=True)]
        matrix.append(row)
    return matrix


def even_sizes(rows: int, shards: int) -> list[int]:
    """Shard sizes that differ by one at most."""
    return [rows // shards + (shard < rows % shards) for shard in range(shards)]


def assign_shards(rows: DataFrame, identity: list[Column], shards: int = 16, seed: int = 20240607, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Adds ``shard`` (int) and ``slot`` (long, gapless from 0 in each shard): a uniform shuffle with exact shard sizes.

    ``identity`` are the columns that tell rows apart; equal rows are interchangeable and each gets its own place.
    The driver draws one count for each bucket, of ``MOST_BUCKETS`` at most, and shard; rows move twice, first within hashed source buckets,
    then to their shard's slot buckets, and each bucket sorts ``bucket_rows`` rows on average.
    Empty tables give no rows; nulls in ``identity`` are values like any other.
    """
    spark = rows.sparkSession
    mark = F.xxhash64(F.lit(seed), *identity)
    marked = settled(rows.withColumn("_mark", mark).withColumn("_copy", F.xxhash64(F.lit(seed + 1), mark)))
    total = marked.count()
    buckets = min(MOST_BUCKETS, max(LEAST_BUCKETS, math.ceil(total / bucket_rows)))
    ties = [c for c in rows.columns]
    placed = marked.withColumn("_bucket", F.pmod("_mark", F.lit(buckets)).cast("int"))
    counts = {r["_bucket"]: r["count"] for r in placed.groupBy("_bucket").count().collect()}
    used = sorted(counts)
    matrix = communication_matrix([counts[b] for b in used], even_sizes(total, shards), seed)
    cuts = []
    for bucket, row in zip(used, matrix, strict=True):
        ends, end = [], 0
        for sent in row[:-1]:
            ends.append(end := end + sent)
        cuts.append((bucket, ends))
    plan = spark.createDataFrame(cuts, "_bucket int, _cuts array<long>")

    in_bucket = Window.partitionBy("_bucket").orderBy("_copy", *ties)
    sent = (
        placed.withColumn("_rank", F.row_number().over(in_bucket).cast("long") - 1)
        .join(plan, "_bucket")
        .withColumn("shard", F.size(F.filter("_cuts", lambda end: end <= F.col("_rank"))))
        .drop("_cuts", "_rank", "_bucket")
    )
    per_shard = max(math.ceil(LEAST_BUCKETS / shards), math.ceil(total / shards / bucket_rows))
    again = F.xxhash64(F.lit(seed + 2), "_copy")
    sent = settled(sent.withColumn("_mark", again).withColumn("_part", F.pmod(again, F.lit(per_shard)).cast("int")))
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sent.groupBy("shard", "_part").agg(F.count("*").alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    in_part = Window.partitionBy("shard", "_part").orderBy("_mark", *ties)
    return (
        sent.withColumn("_place", F.row_number().over(in_part).cast("long") - 1)
        .join(starts.select("shard", "_part", "_start"), ["shard", "_part"])
        .withColumn("slot", F.col("_start") + F.col("_place"))
        .select(*rows.columns, "shard", "slot")
    )


def shard_documents(docs: DataFrame, shards: int = 16, seed: int = 20240607, id_column: str = "doc_id", text_column: str = "text", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for each document row; shard row counts differ by one at most.

    ``size`` is the UTF-8 length plus 1; a null text counts as empty. Repeated rows are all kept, each in its own slot.
    Only ids and digests move, so texts are read once and never shuffled; ``write_shards`` moves them.
    """
    content = F.coalesce(F.col(text_column), F.lit("")).cast("binary")
    digest = docs.select(F.col(id_column).alias("doc_id"), (F.octet_length(content) + 1).cast("long").alias("size"), F.crc32(content).alias("text_crc32"))
    return assign_shards(digest, [F.col(c) for c in digest.columns], shards, seed, bucket_rows)


def write_shards(docs: DataFrame, places: DataFrame, path: str, files_per_shard: int = 1, id_column: str = "doc_id") -> None:
    """Writes each document under ``shard=N``, in slot order inside each file; ``doc_id`` has to be a key here."""
    placed = docs.join(places.select(F.col("doc_id").alias(id_column), "shard", "slot"), id_column)
    (
        placed.repartitionByRange(places.select("shard").distinct().count() * files_per_shard or 1, "shard", "slot")
        .sortWithinPartitions("shard", "slot")
        .write.mode("overwrite")
        .partitionBy("shard")
        .parquet(path)
    )
