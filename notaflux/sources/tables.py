"""Table sources: parquet, JSON and plain text to DataFrames, and the one-row-per-id reading of late tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of a directory of parquet tables; only columns and rows that the query names are read."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def texts_from_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per text file: (doc_id BIGINT derived from the path, text)."""
    return spark.read.text(path, wholetext=True).select(
        F.xxhash64(F.input_file_name()).alias("doc_id"), F.col("value").alias("text")
    )


def texts_from_json(spark: SparkSession, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, text) of a JSON-lines source; the schema is given, so nothing is read to infer it."""
    return spark.read.schema(f"`{key}` BIGINT, `{text}` STRING").json(path).select(
        F.col(key).alias("doc_id"), F.col(text).alias("text")
    )


def texts_from_memory(spark: SparkSession, notes: dict[str, str | None]) -> DataFrame:
    """(doc_id, name, text) of a few notes held by the caller, in the caller's order."""
    rows = [(i, name, text) for i, (name, text) in enumerate(notes.items())]
    return spark.createDataFrame(rows, "doc_id BIGINT, name STRING, text STRING")


def once(df: DataFrame, key: str, first_by: str | None = None, *columns: str) -> DataFrame:
    """One row per ``key``: the least by ``first_by``, then by the kept columns, so ties are settled alike on every run.

    Only ``columns`` (all, if none are named) survive and are shuffled, partially aggregated before the shuffle.
    Rows without a key are nobody's repetition: all of them are kept as they stand, and none of them is shuffled.
    """
    kept = [c for c in (columns or df.columns) if c != key]
    order: list[Column] = [F.col(f"`{first_by}`").alias("__by")] if first_by else []
    packed = F.struct(*order, *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)])
    keyed = df.where(F.col(f"`{key}`").isNotNull())
    least = keyed.groupBy(F.col(f"`{key}`")).agg(F.min(packed).alias("__row")).select(F.col(f"`{key}`"), *[F.col(f"__row.c{i}").alias(c) for i, c in enumerate(kept)])
    # statistics of the files let a scan pass over tables without such rows
    return least.unionByName(df.where(F.col(f"`{key}`").isNull()).select(F.col(f"`{key}`"), *[F.col(f"`{c}`") for c in kept]))
