"""Stages of the corpus pipeline."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitexture.llm.decontamination import contained_items
from bitexture.llm.mixing import mix_sources
from bitexture.llm.sharding import stratified_shards
from bitexture.llm.simhash import near_groups, text_md5
from bitexture.llm.toxicity import score_toxicity, train
from bitexture.session import shared_dir, stored

TOXIC_FROM = 0.7


def held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that score as toxic."""
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held_out())
    scored = score_toxicity(docs.withColumn("__row", F.struct(*docs.columns)), model)
    return scored.where(F.col("toxicity") < TOXIC_FROM).select("__row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one with the smallest id, of repeated
    rows of it one. Decided by id and text together, so another text under an
    id that is given away stays. Documents without id stay."""
    groups = stored(near_groups(docs), "groups")
    gone = stored(groups.where(~F.col("first")).select("doc_id", "text_md5").distinct(), "copies")
    kept = docs.withColumn("__md5", text_md5("text"))
    twin = [kept["doc_id"] == gone["doc_id"], kept["__md5"] == gone["text_md5"]]
    kept = kept.join(gone, twin, "left_anti")
    # rows that repeat an id and its text
    again = groups.where("first").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
    if not again.isEmpty():
        again = stored(again, "repeated")
        once = kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "__md5"])
        kept = kept.join(again, "doc_id", "left_anti").unionByName(once.select(kept.columns))
    return kept.select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that contain a benchmark item."""
    found = contained_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    leaks = stored(found.select("doc_id").distinct(), "leaks")
    return docs.join(leaks, "doc_id", "left_anti").select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture of the sources, in its order; small sources come again."""
    mixed = mix_sources(docs)
    return mixed.orderBy("mix_slot", "mix_row").select(*docs.columns)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Eight shards that match the mixture; adds ``shard`` and ``slot``."""
    return stratified_shards(docs)


STAGES = [
    ("toxicity", toxicity),
    ("simhash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing to target weights", mixing),
    ("sharding", sharding),
]

#: SQL has no character decoding, fingerprints or hashes of this kind.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each one is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        path = f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}-{i}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
