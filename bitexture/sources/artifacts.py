"""File inventories: required inputs and run artifacts. File contents are never
read, only path and length."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitexture.functions.text import epoch_from_name
from bitexture.sources.paths import path_exists

_FILES = "path string, length bigint"


def _list_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    found = [p for p in paths if path_exists(spark, p)]
    if not found:
        return spark.createDataFrame([], _FILES)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(found)
    return files.select("path", "length")


def input_manifest(spark: SparkSession, required: Mapping[str, str]) -> DataFrame:
    """``name, path, present, mb`` for each required file; for a folder, of all
    files below it. The list comes from the caller's code and is short."""

    def entry(name: str, path: str) -> DataFrame:
        sizes = _list_files(spark, [path]).agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("length"))
        return sizes.select(
            F.lit(name).alias("name"),
            F.lit(path).alias("path"),
            (F.col("n") > 0).alias("present"),
            F.round(F.col("length") / 1e6, 1).alias("mb"),
        )

    entries = [entry(name, path) for name, path in required.items()]
    if not entries:
        return spark.createDataFrame([], "name string, path string, present boolean, mb double")
    return reduce(DataFrame.unionAll, entries)


def all_present(manifest: DataFrame) -> DataFrame:
    """One row: whether every required file is there."""
    return manifest.agg(F.min("present").alias("all_ok"))


def list_artifacts(spark: SparkSession, glob: str) -> DataFrame:
    """``name, length, epoch`` of the files a glob matches; the epoch is read
    from the name, 0 where it does not parse."""
    files = _list_files(spark, [glob])
    return files.select(
        F.element_at(F.split("path", "/"), -1).alias("name"), "length", epoch_from_name(F.col("path")).alias("epoch")
    )
