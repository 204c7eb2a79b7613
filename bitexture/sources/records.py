"""Translation records and run histories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bitexture.sources.paths import path_exists

RUN_SCHEMA = "epoch bigint, val_loss double, train_loss double, lr double, _bad string"
PAIR_SCHEMA = "line_no bigint, lang string, src string, tgt string"


def translation_text(record: Column, kind: T.DataType, lang: str) -> Column:
    """Text of one language in a record, ``""`` where it is missing. A struct
    is read field by field; a map has to be read whole."""
    if isinstance(kind, T.StructType):
        value = record[lang] if lang in kind.fieldNames() else F.lit(None).cast("string")
    else:
        value = F.try_element_at(record, F.lit(lang))
    return F.coalesce(value, F.lit(""))


def read_translations(spark: SparkSession, path: str, tgt: str, src: str = "en") -> DataFrame:
    """``line_no, lang, src, tgt`` (raw text) from Parquet records with a
    ``translation`` map or struct; numbered over the files in name order."""
    raw = spark.read.parquet(path)
    rows = raw.withColumns({"__path": F.col("_metadata.file_path"), "__row": F.col("_metadata.row_index")})
    # one row per file
    files = rows.groupBy("__path").agg((F.max("__row") + 1).alias("__n"))
    earlier = Window.orderBy("__path").rowsBetween(Window.unboundedPreceding, -1)
    bases = files.select("__path", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__base"))
    pairs = rows.join(bases, "__path").withColumn("__line", F.col("__base") + F.col("__row"))
    parsed = parse_translations(pairs, tgt, src, F.col("__line").alias("line_no"))
    return parsed.select("line_no", "lang", "src", "tgt")


def parse_translations(df: DataFrame, tgt: str, src: str = "en", *extra: Column) -> DataFrame:
    kind = df.schema["translation"].dataType
    record = F.col("translation")
    return df.select(
        *extra,
        F.lit(tgt).alias("lang"),
        translation_text(record, kind, src).alias("src"),
        translation_text(record, kind, tgt).alias("tgt"),
    )


def read_first_available(spark: SparkSession, paths: Sequence[str], tgt: str, src: str = "en") -> tuple[DataFrame, str | None]:
    """Records of the first path that exists, with that path; no path gives an
    empty table and ``None``."""
    for path in paths:
        if path_exists(spark, path):
            return read_translations(spark, path, tgt, src), path
    return spark.createDataFrame([], PAIR_SCHEMA), None


def read_run_history(spark: SparkSession, path: str) -> DataFrame:
    """``epoch, val, train, lr`` from JSON lines, one per checkpoint, ordered
    by epoch. A missing field is 0; an unreadable record is skipped."""
    raw = spark.read.schema(RUN_SCHEMA).option("columnNameOfCorruptRecord", "_bad").json(path)
    zero = F.lit(0.0)
    return (
        raw.where(F.col("_bad").isNull())
        .select(
            F.coalesce("epoch", F.lit(0)).alias("epoch"),
            F.coalesce("val_loss", zero).alias("val"),
            F.coalesce("train_loss", zero).alias("train"),
            F.coalesce("lr", zero).alias("lr"),
        )
        .orderBy("epoch")
    )
