"""The note pipeline over a stream: it is local to the row, so it runs unchanged, without state and without watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from notaflux.conf import EngineConf
from notaflux.operators.entities import entity_rows
from notaflux.plans.pipeline import expanded


def note_stream(spark: SparkSession, path: str, schema: str = "note_id BIGINT, text STRING", files_per_trigger: int = 100) -> DataFrame:
    """New parquet files of a folder as a stream of notes."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def entity_stream(notes: DataFrame, key: str = "note_id", conf: EngineConf | None = None) -> DataFrame:
    """The entities of every note that arrives, a row each."""
    return entity_rows(expanded(notes, conf=conf), key)


def write_entities(notes: DataFrame, path: str, checkpoint: str, key: str = "note_id", conf: EngineConf | None = None) -> StreamingQuery:
    """Append entities to a parquet folder until what is there is done; restarting goes on where it stopped."""
    return entity_stream(notes, key, conf).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
