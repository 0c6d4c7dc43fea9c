"""A folder that all executors share, for tables that queries write."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession, what: str) -> str:
    """A fresh path below spark.checkpoint.dir.  Where that is unset, below a folder of our own, but only for a local
    master: on a cluster each machine would have another."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not folder and current.isDefined():
        folder = current.get()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="stratalog-")
        spark.sparkContext.setCheckpointDir(folder)
    return f"{folder.rstrip('/')}/{what}-{uuid.uuid4().hex}"
