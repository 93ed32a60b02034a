"""Session and table-view helpers."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def get_session(app: str = "rowmill", **conf: str) -> SparkSession:
    """A session with the settings the engine relies on; ``conf`` wins over them.

    Nothing here fixes a size: partition counts come from the deployment or from adaptive execution.
    """
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
    } | conf
    builder = SparkSession.builder.appName(app)
    if "spark.master" not in settings and not os.environ.get("SPARK_REMOTE"):
        settings["spark.master"] = os.environ.get("ROWMILL_MASTER", "local[*]")
    return builder.config(map=settings).getOrCreate()


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The Parquet table ``name`` under ``root`` (a file or a directory, on any file system that Spark reads)."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def register_views(spark: SparkSession, root: str, sql: str | None = None) -> None:
    """Register the tables under ``root`` as temporary views; with ``sql``, only those whose names occur in it."""
    words = None if sql is None else set(re.findall(r"\w+", sql.lower()))
    for name in TABLES:
        if words is None or name in words:
            table(spark, root, name).createOrReplaceTempView(name)
