"""Record files as a stream: new files in a folder become rows of a table."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from lexiloom.sources.records import parse_records, typed_records


def ingest_stream(spark: SparkSession, folder: str, target: str, checkpoint: str, schema: dict[str, str]) -> StreamingQuery:
    """Takes what is there and ends; started again, it goes on with the files that came since."""
    lines = spark.readStream.option("recursiveFileLookup", True).text(folder)
    rows = typed_records(parse_records(lines), schema)
    return rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
