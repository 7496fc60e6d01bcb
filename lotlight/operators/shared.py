"""The folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new path in the folder that all executors share; only in one process, as in tests, may that be a temporary one."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = tempfile.mkdtemp(prefix="lotlight-")
        atexit.register(shutil.rmtree, where, ignore_errors=True)
    return f"{where.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def gone_at_end(spark: SparkSession, where: str) -> None:
    """Have a path deleted when the driver ends."""
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
