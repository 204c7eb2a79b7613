"""Even work for inputs with too few splits."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """Redistributes a scan that has fewer splits than there are cores, as one
    small file with heavy text work has. A large input is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
