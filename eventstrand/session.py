"""Session settings and the shared folder that jobs write to."""

from __future__ import annotations

import atexit
import json
import re
import shutil
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

# Runtime settings (no restart needed).  Skewed joins are split even where that costs a shuffle.
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators are planned for."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, from ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own, which goes with the process.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        configured = tempfile.mkdtemp(prefix="eventstrand-")
        atexit.register(shutil.rmtree, configured, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", configured)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(configured)
    return configured


_folders: dict[str, str] = {}


def session_folder(spark: SparkSession) -> str:
    """A folder below :func:`shared_dir` for results that are read later; it goes when the application ends."""
    key = spark.sparkContext.applicationId
    if key not in _folders:
        path = f"{shared_dir(spark)}/session-{uuid.uuid4().hex}"
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(folder)
        files.deleteOnExit(folder)
        _folders[key] = path
    return _folders[key]


def materialise(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: rows and partition numbers stay fixed when executors are lost."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder on whatever file system it is; nothing happens if there is none."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def folder_exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def check_manifest(spark: SparkSession, path: str, settings: dict) -> None:
    """Record what a stored dataset is made with, or refuse to go on with other settings than recorded."""
    text = json.dumps(settings, sort_keys=True, default=str)
    try:
        recorded = spark.read.text(path).collect()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        recorded = []
    if not recorded:
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
    elif recorded[0].value != text:
        raise ValueError(f"dataset was begun with {recorded[0].value}, not {text}")
