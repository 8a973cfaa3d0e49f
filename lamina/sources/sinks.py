"""Sinks (K1-K18): JSON lines, CSV mirrors, partitioned tables and keyed upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lamina.sources.buckets import BucketedTable


def write_sentences(df: DataFrame, folder: str) -> None:
    """K1, K2: JSON lines, and a CSV mirror with labels joined and a column per score."""
    df.write.mode("overwrite").json(f"{folder}/jsonl")
    flat = df
    if "labels" in df.columns:
        flat = flat.withColumn("labels", F.array_join("labels", ", "))
    if "scores" in df.columns:
        for k in ("Environmental", "Social", "Governance", "Neutral"):
            flat = flat.withColumn(f"score_{k}", F.col("scores")[k])
        flat = flat.drop("scores")
    flat.write.mode("overwrite").option("header", True).csv(f"{folder}/csv")


def write_by(df: DataFrame, folder: str, *keys: str) -> None:
    """One folder per key; only the partitions that ``df`` has are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).json(folder)


def append_rejected(df: DataFrame, folder: str) -> None:
    """Rejected rows, appended."""
    df.write.mode("append").json(folder)


def upsert(fresh: DataFrame, folder: str, keys: list[str], order: str) -> None:
    """K9-K11, ST4: rows keyed by ``keys``; of equal keys the greatest ``order`` stays. Touched buckets alone are rewritten."""
    BucketedTable(fresh.sparkSession, folder, keys).upsert(fresh, order)
