"""The folder that driver and executors share, for tables that outlive a job."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names. On one machine, where it is unset, a temporary folder; elsewhere that is an error, for executors would
    write to disks of their own."""
    context = spark.sparkContext
    if named := context.getConf().get("spark.checkpoint.dir"):
        return named
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _folders:
        _folders[context.applicationId] = tempfile.mkdtemp(prefix="brightcask-")
    return _folders[context.applicationId]
