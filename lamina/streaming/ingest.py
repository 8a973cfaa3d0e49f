"""Incremental ingestion (ST1, ST2, ST4, ST6): file sources, keyed upserts, windows over late facts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from lamina.sources.sinks import upsert


def files(spark: SparkSession, folder: str, schema, kind: str = "parquet") -> DataFrame:
    return spark.readStream.format(kind).schema(schema).load(folder)


def upsert_available(stream: DataFrame, table: str, checkpoint: str, keys: list[str], order: str) -> None:
    """ST1, ST4: everything that has come since the last run, once: the checkpoint says what is done,
    and a batch that is repeated after a failure changes nothing."""
    query = stream.writeStream.foreachBatch(lambda df, _: upsert(df, table, keys, order)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def windowed_counts(stream: DataFrame, time: str, key: str, late: str = "1 day", width: str = "1 hour") -> DataFrame:
    """ST6: counts per key and window, windows closing ``late`` after the latest time seen."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count("*").alias("n"))


def dedup(stream: DataFrame, time: str, keys: list[str], late: str = "1 day") -> DataFrame:
    """ST4: the first of equal keys within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def apply_batches(stream: DataFrame, checkpoint: str, step: Callable[[DataFrame, int], None]) -> None:
    query = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def spaced(requests: DataFrame, host: str, at: str, least: float) -> DataFrame:
    """ST3: when each request may go out, at least ``least`` seconds after the one before to the same host: adds ``goes_at`` (seconds).

    The k-th request of a host goes no sooner than any earlier one's time plus the spacing for those between, a running
    maximum, so nothing is looped over.
    """
    w = W.partitionBy(host).orderBy(at)
    k = F.row_number().over(w)
    ahead = requests.withColumn("_k", k).withColumn("_slack", F.col(at).cast("double") - F.col("_k") * least)
    return ahead.withColumn("goes_at", F.max("_slack").over(w.rowsBetween(W.unboundedPreceding, 0)) + F.col("_k") * least).drop("_k", "_slack")


def recent(rows: DataFrame, time: str, years: int, now) -> DataFrame:
    """ST5: rows of the last ``years`` years before ``now``; rows without a time are kept, as nothing tells that they are old."""
    since = F.lit(now).cast("timestamp") - F.make_interval(years=F.lit(years))
    return rows.filter(F.col(time).isNull() | (F.col(time) >= since))
