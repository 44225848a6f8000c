"""Session settings the jobs are written for."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # One Arrow batch of pages must fit a Python worker: rows are whole documents.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "256",
}


def get_session(app: str = "pagespark", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder under the cluster's shared checkpoint folder.

    The session setting wins; only in local mode an unset one falls back to a
    temporary folder of this machine, which no other machine could see.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
        base = os.path.join(tempfile.gettempdir(), "pagespark-checkpoints")
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
