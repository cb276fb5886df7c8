"""Files of a session's own in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def hadoop_path(spark: SparkSession, path: str):
    """The path and its file system."""
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(sc._jsc.hadoopConfiguration())


def shared_dir(spark: SparkSession) -> str:
    """The application's folder under spark.checkpoint.dir, deleted when the application ends. Where that is unset, a local
    master (tests) gets a temporary folder; on a cluster it is an error, as no local folder is shared there."""
    sc = spark.sparkContext
    found = getattr(sc, "_mosaiq_scratch", None)
    if found:
        return found
    place = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not place:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        place = "file://" + tempfile.mkdtemp(prefix="mosaiq-shared-")
        sc.setCheckpointDir(place)
    sc._mosaiq_scratch = f"{place.rstrip('/')}/mosaiq-{sc.applicationId}"
    path, fs = hadoop_path(spark, sc._mosaiq_scratch)
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return sc._mosaiq_scratch


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    p, fs = hadoop_path(spark, path)
    fs.delete(p, True)
