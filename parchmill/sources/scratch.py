"""Folders for what a query writes and reads again."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

_own: list[str] = []


def scratch_folder(spark: SparkSession, tag: str) -> str:
    """A new folder's URI below ``spark.checkpoint.dir``, which all executors share; it is deleted when the driver ends.

    Where the setting is missing, a temporary folder serves local mode, and nothing else.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="parchmill-"))
        base = _own[0]
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/parchmill/{sc.applicationId}/{tag}-{uuid.uuid4().hex}")
    # a folder without a scheme lies on the cluster's default file system
    folder = re.sub("^file:/+", "file:///", path.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(path).toString())
    atexit.register(_delete, spark, folder)
    return folder


def _delete(spark: SparkSession, folder: str) -> None:
    sc = spark.sparkContext
    if sc._jsc is None or sc._jsc.sc().isStopped():
        return
    target = sc._jvm.org.apache.hadoop.fs.Path(folder)
    target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)
