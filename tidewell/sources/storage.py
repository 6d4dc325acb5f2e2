"""The folder that the driver and all executors share, and its files from Python."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def qualified(spark: SparkSession, path: str) -> str:
    """The path as Spark itself resolves it: one without a scheme belongs to the session's default file system."""
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(own).toString().rstrip("/")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session names, qualified; a temporary one only where all runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tidewell-")
        spark.sparkContext.setCheckpointDir(found)
    return qualified(spark, found)


def filesystem(path: str):
    """The pyarrow file system of a qualified path, and the path in it."""
    from pyarrow import fs

    scheme, rest = path.split(":", 1) if ":" in path.split("/", 1)[0] else ("", path)
    if not scheme:
        raise ValueError(f"{path} has no scheme; qualify it on the driver first")
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(f"{'s3' if scheme in ('s3a', 's3n') else scheme}:{rest}")


def publish(fs, own: str, name: str) -> None:
    """Gives a whole file its name.  Another attempt of the same task may have done so; its file is the same."""
    try:
        fs.move(own, name)
    except OSError:
        if not fs.get_file_info(name).is_file:
            raise
        fs.delete_file(own)
