"""Where jobs that must write (streams, tables made on the fly) put their files."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by the cluster.

    Only a local master, where driver and executors are one process, may fall
    back to a folder of this machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    return tempfile.gettempdir()


def new_run_dir(spark: SparkSession, label: str) -> str:
    """A fresh, unique path below the shared folder; nothing is created yet."""
    return f"{shared_dir(spark)}/tidemark-{label}-{uuid.uuid4().hex}"
