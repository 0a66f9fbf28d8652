"""Incremental ingest: new rows are normalised, and those whose key is already stored are left out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dedup import deduplicate
from ..plans.pipeline import normalise

VALUE = "valorobservado"


def upsert_batch(batch: DataFrame, store: str, dataset_id: str, date_column: str) -> int:
    """Appends rows with a new ``floating_id``, or a greater value than its stored ones, to the Parquet store, partitioned by
    month; returns how many. ``read_store`` keeps the greatest of each, so batches may come again and in any order.

    Only the months that the batch touches are read, so the check does not grow with the store; rows without a date are
    a month of their own.
    """
    spark = batch.sparkSession
    fresh = deduplicate(normalise(batch, dataset_id, date_column), date_column).withColumn("month", F.date_format(date_column, "yyyy-MM")).persist()
    try:
        try:
            known = spark.read.parquet(store)
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            known = fresh.limit(0)
        months = [r["month"] for r in fresh.select(F.coalesce("month", F.lit("")).alias("month")).distinct().collect()]
        value = F.col(VALUE) if VALUE in fresh.columns else F.lit(None).cast("double")
        stored = known.filter(F.coalesce("month", F.lit("")).isin(months)).select(F.col("floating_id").alias("_stored"), value.alias("_value"))
        no_greater = value.isNull() | F.coalesce(F.col("_value") >= value, F.lit(False))
        new = fresh.join(stored, (F.col("floating_id") == F.col("_stored")) & no_greater, "left_anti").persist()
        count = new.count()
        if count:
            new.write.mode("append").partitionBy("month").parquet(store)
        new.unpersist()
        return count
    finally:
        fresh.unpersist()


def read_store(spark: SparkSession, store: str, date_column: str = "fechaobservacion") -> DataFrame:
    """The stored rows, the greatest value of each measurement (DD1)."""
    return deduplicate(spark.read.parquet(store), date_column)


def ingest(spark: SparkSession, source: str, schema, store: str, checkpoint: str, dataset_id: str, date_column: str = "fechaobservacion", available_now: bool = True):
    """A file stream into the store; one micro-batch is applied at a time and can be repeated without harm."""
    stream = spark.readStream.schema(schema).json(source)
    writer = stream.writeStream.foreachBatch(lambda batch, _: upsert_batch(batch, store, dataset_id, date_column)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def late_monthly_counts(events: DataFrame, at: str, key: str, lateness: str = "1 day") -> DataFrame:
    """Rows by key and day with a watermark; NTZ times are read as UTC, which a watermark needs."""
    timed = events.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", lateness)
    return timed.groupBy(F.window("_at", "1 day"), key).agg(F.count("*").alias("n"))
