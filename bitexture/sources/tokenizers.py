"""A trained vocabulary on disk: two tables and one row of settings."""

from __future__ import annotations

from pyspark.sql import SparkSession

from bitexture.operators.bpe import BpeModel

_META = "vocab_size bigint, min_frequency int, corpus string, special_tokens array<string>"


def write_tokenizer(
    model: BpeModel, folder: str, min_frequency: int, corpus: str, mode: str = "errorifexists"
) -> None:
    spark = model.vocab.sparkSession
    # both tables are bounded by the vocabulary size: one file each
    model.vocab.coalesce(1).write.mode(mode).parquet(f"{folder}/vocab")
    model.merges.coalesce(1).write.mode(mode).parquet(f"{folder}/merges")
    meta = [(model.vocab.count(), min_frequency, corpus, list(model.specials))]
    spark.createDataFrame(meta, _META).coalesce(1).write.mode(mode).parquet(f"{folder}/meta")


def read_tokenizer(spark: SparkSession, folder: str) -> BpeModel:
    meta = spark.read.schema(_META).parquet(f"{folder}/meta").head()
    return BpeModel(
        spark.read.schema("token string, id int").parquet(f"{folder}/vocab"),
        spark.read.schema("rank int, left string, right string, merged string").parquet(f"{folder}/merges"),
        tuple(meta.special_tokens),
    )
