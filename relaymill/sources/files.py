"""Small helpers on the shared file system, through Spark's own Hadoop client."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _open(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _open(spark, path)
    return fs.exists(target)


def is_complete(spark: SparkSession, path: str) -> bool:
    """A dataset folder whose write job was committed."""
    return exists(spark, f"{path}/_SUCCESS")


def children(spark: SparkSession, path: str) -> list[str]:
    fs, target = _open(spark, path)
    if not fs.exists(target):
        return []
    return sorted(status.getPath().getName() for status in fs.listStatus(target))


def partition_values(spark: SparkSession, path: str, name: str) -> list[str]:
    """Values in ``name=value`` sub-folders."""
    prefix = f"{name}="
    return [c[len(prefix):] for c in children(spark, path) if c.startswith(prefix)]


def complete(spark: SparkSession, pattern: str) -> list[str]:
    """Folders matching a pattern whose write job was committed, found in one listing."""
    fs, target = _open(spark, f"{pattern}/_SUCCESS")
    return sorted(s.getPath().getParent().toString() for s in (fs.globStatus(target) or []))


def remove(spark: SparkSession, path: str) -> None:
    fs, target = _open(spark, path)
    fs.delete(target, True)


def move(spark: SparkSession, path: str, target: str) -> None:
    """Rename a folder, with the parents of its new name; what is there already is kept."""
    fs, source = _open(spark, path)
    to = spark._jvm.org.apache.hadoop.fs.Path(target)
    if not fs.exists(to):
        fs.mkdirs(to.getParent())
        if not fs.rename(source, to):
            raise OSError(f"cannot move {path} to {target}")


def make(spark: SparkSession, path: str) -> None:
    fs, target = _open(spark, path)
    fs.mkdirs(target)
