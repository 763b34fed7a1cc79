"""Sinks: processed notes as JSON lines or parquet, and metrics observed while they are written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.observation import Observation


def as_json(value: Column) -> Column:
    """The JSON of a struct or array of structs; absent fields are left out, letters are written as they are."""
    return F.to_json(value)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists", *partition_by: str) -> None:
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def counted(df: DataFrame, name: str = "notes") -> tuple[DataFrame, Observation]:
    """``df`` with an observation of its rows, entities and relations, which is filled by the action that runs anyway."""
    seen = Observation(name)
    metrics = [F.count(F.lit(1)).alias("rows")]
    for c in ("entities", "relations"):
        if c in df.columns:
            metrics.append(F.sum(F.size(c)).alias(c))
    return df.observe(seen, *metrics), seen
