"""The keyed upsert fed by newly arriving files."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from daygauge.sources.sinks import upsert_months


def new_rows(spark: SparkSession, path: str, schema: str, *, encoding: str = "UTF-8") -> DataFrame:
    """Stream of the CSV files that appear below a folder, with the name of the file of each row."""
    reader = (spark.readStream.schema(schema).option("header", True).option("encoding", encoding)
              .option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv"))
    return reader.csv(path).select("*", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1).alias("source_file"))


def start_upsert(stream: DataFrame, table: str, key: Sequence[str], order: Sequence[str], *, checkpoint: str,
                 timestamp: str = "timestamp", tidy: Callable[[DataFrame], DataFrame] = lambda df: df) -> StreamingQuery:
    """Take in everything not seen yet and stop.

    A batch that is repeated after a failure writes the same rows again under the same keys, so the table comes out the
    same.
    """
    def take(batch: DataFrame, _: int) -> None:
        upsert_months(batch.sparkSession, table, tidy(batch), key, order, timestamp=timestamp)

    return (stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
