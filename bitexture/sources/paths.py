"""File listing through Spark's own file systems, so any path Spark can read
can be listed."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _glob(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs, fs.globStatus(p) or []


def path_exists(spark: SparkSession, path: str) -> bool:
    """True if the path, or any path a glob matches, exists."""
    return len(_glob(spark, path)[1]) > 0


def path_size(spark: SparkSession, path: str) -> tuple[int, int]:
    """Number and total length of the files below the path or glob."""
    fs, found = _glob(spark, path)
    sums = [fs.getContentSummary(status.getPath()) for status in found]
    return sum(s.getFileCount() for s in sums), sum(s.getLength() for s in sums)
