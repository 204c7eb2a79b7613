"""The corpus pipeline: five operators, one after the other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bitexture.llm.pipeline import ORACLE_SQL, STAGES, run
from bitexture.plans.registry import Query

__all__ = ["ORACLE_SQL", "QUERY", "STAGES", "run"]


def _query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir)


QUERY = Query(_query, ORACLE_SQL)
