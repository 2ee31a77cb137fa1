"""Watching a run: ledger rows as they are appended, counted by cell.

A cell's results arrive row by row or file by file; this reads them as a stream, so a
long phase can be followed without rereading what has been counted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from packwright.operators.metrics import confusion
from packwright.sources.pairs import LEDGER_SCHEMA


def ledger_stream(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    return spark.readStream.schema(LEDGER_SCHEMA).option("maxFilesPerTrigger", max_files).option("pathGlobFilter", "*.json*").json(path)


def progress(rows: DataFrame) -> DataFrame:
    """Rows, failures, unreadable replies and the confusion counts of each cell so far."""
    clean = F.col("n_backend_failures") == 0
    parsed = clean & (F.col("prediction") != -1)
    return rows.groupBy("selector", "representation", "budget", "backend").agg(
        F.count("*").alias("n_samples"),
        F.count_if(~clean).alias("n_failed"),
        F.count_if(clean & (F.col("prediction") == -1)).alias("n_unreadable"),
        *[c.cast("long").alias(k) for k, c in confusion(parsed).items()],
    )


def watch(spark: SparkSession, path: str, name: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Keep the progress of all cells in the in-memory table ``name``."""
    out = progress(ledger_stream(spark, path)).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out).start()
