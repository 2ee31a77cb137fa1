"""Session construction and the small I/O helpers that every query shares."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import os

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "packwright", cores: str = "*", **conf: str) -> SparkSession:
    """A local session for tests and benches; a cluster brings its own session.

    Adaptive execution stays on: it coalesces small partitions and splits skewed
    joins, which is what the operators rely on at scale.
    """
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("PACKWRIGHT_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table. The path may be on any store that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_own: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir).

    Where that is unset, local mode gets a folder of its own; a cluster must set it.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="packwright-base-"))
            atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
        where = f"file://{_own[0]}"
    return f"{where.rstrip('/')}/packwright-{uuid.uuid4().hex}/{name}"
