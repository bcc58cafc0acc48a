"""Folders for files that queries write and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A fresh subfolder of the checkpoint folder the session names, or of its warehouse where that is unset.

    On a cluster all executors share both; a machine's own temporary folder is never used.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir") + "/_scratch"
    return f"{base.rstrip('/')}/judgespark-{uuid.uuid4().hex}"
