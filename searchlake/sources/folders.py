"""Folders for files that a query writes and reads back: shared by driver and executors, gone when the process ends."""

from __future__ import annotations

import atexit
import logging
import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only on one machine, where it is unset, a folder of this process."""
    try:
        found = spark.conf.get("spark.checkpoint.dir")
    except Exception as error:  # the setting is not there at all
        if "spark.checkpoint.dir" not in str(error):
            raise
        found = None
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{tempfile.gettempdir()}/searchlake-{os.getpid()}"


def remove(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other call gets."""
    path = f"{shared_root(spark)}/searchlake-{uuid.uuid4().hex}/{name}"

    def close() -> None:
        try:
            remove(spark, path.rsplit("/", 1)[0])
        except Exception as error:  # the JVM may be gone by then
            logging.getLogger(__name__).debug("folder %s is left: %s", path, error)

    atexit.register(close)
    return path
