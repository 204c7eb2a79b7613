"""All registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitexture.operators import corpus as C
from bitexture.plans import corpus_queries, metric_queries, source_queries, stream_queries, text_queries, token_queries  # noqa: F401
from bitexture.plans import inputs as I
from bitexture.plans.registry import QUERIES, query

_CAP = 1_000


@query(
    I.with_inputs(
        f"""SELECT lang, 2 * count(*) AS n_lines, 2 * sum(length(src) + length(tgt)) AS n_chars FROM (
              SELECT *, row_number() OVER (PARTITION BY lang ORDER BY line_no) AS rn FROM judged_pairs WHERE reason IS NULL)
            WHERE rn <= {_CAP} GROUP BY 1""",
        "judged_pairs",
    )
)
def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Valid tagged training lines per language, from raw line pairs."""
    pairs = C.cap_per_language(I.dirty_pairs(spark, sf), _CAP)
    sizes = F.length("src") + F.length("tgt")
    tagged = C.both_directions(pairs.withColumn("__chars", sizes), I.TAGS)
    return tagged.groupBy("lang").agg(F.count(F.lit(1)).alias("n_lines"), F.sum("__chars").alias("n_chars"))
