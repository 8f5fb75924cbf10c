"""Text security on streams: the stateless operators as they are, from files to files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import security
from ..sources.trees import stream_source_files


def secured(df: DataFrame, text: str = "text") -> DataFrame:
    """Threat columns and redacted text; the same for tables and streams."""
    return security.redact(security.scan_text(df, text), text)


def secure_stream(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, text: str = "text"):
    """Reads new Parquet files of a folder, and writes their secured rows; ends when all that is there has been read."""
    stream = secured(spark.readStream.schema(schema).parquet(source), text)
    return stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def secure_tree(spark: SparkSession, root: str, sink: str, checkpoint: str, partitions: int = 64):
    """The files of a source tree with threats and redacted contents, each once; a later run takes what has come since."""
    stream = secured(stream_source_files(spark, root, partitions), "content")
    return stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
