"""Folders of the file system that Spark itself reads, whichever it is."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder, in order; none if there is no such folder."""
    system, folder = _at(spark, path)
    if not system.exists(folder):
        return []
    return sorted(status.getPath().getName() for status in system.listStatus(folder))


def exists(spark: SparkSession, path: str) -> bool:
    system, folder = _at(spark, path)
    return system.exists(folder)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder and all in it."""
    system, folder = _at(spark, path)
    system.delete(folder, True)
