"""Registered queries of the subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitexture.llm import clustering, decontamination, html_extract, line_dedup, mixing, secret_scan, sharding, simhash, sketches, token_counts, toxicity, url_filter, whitening
from bitexture.llm.pipeline import TOXIC_FROM, held_out
from bitexture.plans.registry import Query, Run

QUERIES: dict[str, Query] = {}

#: Example rules for hosts and paths (verdict, host, path).
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
#: Tokenizer file and limit of the token counts.
TOKENIZER = "byte_bpe_50k.json"
TOKEN_LIMIT = 512
#: Pages whose id this divides give the list of URLs for the filter.
LIST_EVERY = 100


def query(sql: str | None = None):
    def add(run: Run) -> Run:
        QUERIES[run.__name__] = Query(run, sql)
        return run

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def sha256(text) -> F.Column:
    return F.sha2(F.encode(text, "utf-8"), 256)


@query()
def op1_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    """Sketches of documents and of their edited texts, and how alike they are."""
    docs = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # rows of neighbouring ids come together before the texts are hashed, so
    # that only texts are shuffled
    run = F.coalesce(F.shiftright(F.col("doc_id"), sketches.RUN_BITS), F.lit(-(2**62)))
    both = sketches.with_next(docs.repartition(run), "doc_id", ["text"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    out = both.withColumn("n_chars", n.cast("bigint")).withColumn(
        "edited", F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    )
    for name, text in (("s", "text"), ("e", "edited"), ("x", "next_text")):
        out = out.withColumn(name, sketches.text_sketch(F.col(text)))
    return out.select(
        "doc_id",
        "n_chars",
        sha256("edited").alias("edited_sha256"),
        sketches.fingerprint_text(F.col("s")).alias("fingerprint"),
        sketches.fingerprint_text(F.col("e")).alias("edited_fingerprint"),
        sketches.resemblance(F.col("s"), F.col("e")).alias("near_edited"),
        sketches.resemblance(F.col("s"), F.col("x")).alias("near_next"),
        sketches.distinct_shingles(F.col("s")).alias("n_shingles"),
        sketches.containment(F.col("s"), F.col("e")).alias("in_edited"),
    )


@query()
def op2_html_text(spark: SparkSession, sf: str) -> DataFrame:
    """Main text of every page."""
    out = html_extract.extract_main_text(table(spark, sf, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("bigint").alias("n_chars"))


@query()
def op3_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    """Toxicity of every document, learned from the labels of two folds."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf, "labels"), ~held_out())
    out = toxicity.score_toxicity(docs, model)
    return out.select(
        "doc_id",
        F.coalesce(held_out(), F.lit(False)).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= TOXIC_FROM).cast("int").alias("predicted"),
    )


@query()
def op4_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Secrets in every document: fixed patterns and assigned literals."""
    out = secret_scan.scan_secrets(table(spark, sf, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", sha256("base_spans").alias("base_sha256"), "spans")


_KEY = r"trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13)))"


@query(
    f"""WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
         lines AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM split),
         keyed AS (SELECT *, {_KEY} AS key FROM lines),
         shared AS (SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 40 AND doc_id IS NOT NULL
                    GROUP BY 1 HAVING count(DISTINCT doc_id) >= 5),
         marked AS (SELECT k.*, s.key IS NOT NULL AND k.doc_id <> s.last AS gone FROM keyed k LEFT JOIN shared s USING (key))
       SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
         sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
       FROM marked GROUP BY 1"""
)
def op5_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Documents without the lines that many documents share."""
    out = line_dedup.drop_shared_lines(table(spark, sf, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", sha256("kept").alias("kept_sha256"))


@query()
def op6_mix_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Where each document stands in a mixture of the sources."""
    return mixing.mix_sources(table(spark, sf, "documents").select("doc_id", "source"))


@query()
def op7_stratified_shards(spark: SparkSession, sf: str) -> DataFrame:
    """Shards of equal row counts and equal mixture."""
    docs = table(spark, sf, "documents")
    text = F.coalesce(F.col("text"), F.lit(""))
    light = docs.select(
        "doc_id",
        "source",
        (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(F.encode(text, "utf-8")).alias("text_crc32"),
    )
    out = sharding.stratified_shards(light)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query()
def op8_benchmark_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark items of which a document contains at least four fifths."""
    return decontamination.contained_items(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query()
def op9_simhash(spark: SparkSession, sf: str) -> DataFrame:
    """Groups of documents whose fingerprints differ in two bits or fewer."""
    return simhash.near_duplicates(table(spark, sf, "documents"), words=3, distance=2)


@query()
def op10_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Verdict on every page URL: the longest rule, else the URL list."""
    pages = table(spark, sf, "pages").select("page_id", "url")
    listed = pages.where(F.col("page_id") % LIST_EVERY == 0).select("url")
    out = url_filter.judge_urls(pages, listed, URL_RULES)
    return out.select("page_id", "host", "path", "rule", "verdict", "canonical", "listed")


def _assign_sql(rounds: int) -> str:
    """Rounds of assignment and means, as chained table expressions."""
    parts = []
    for i in range(rounds + 1):
        parts.append(
            f"""near{i} AS MATERIALIZED (SELECT row_id, any_value(vec_id) AS vec_id, any_value(v) AS v,
                  min({{'d': list_sum(list_transform(list_zip(v, cv), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT, 'c': c}}) AS best
                FROM kept, cents{i} GROUP BY row_id)"""
        )
        if i < rounds:
            parts.append(
                f"""means{i} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY pos) AS cv FROM (
                      SELECT c, pos, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (
                        SELECT best.c AS c, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM near{i}) GROUP BY 1, 2) GROUP BY 1),
                    cents{i + 1} AS MATERIALIZED (SELECT c, coalesce(m.cv, o.cv) AS cv FROM cents{i} o LEFT JOIN means{i} m USING (c))"""
            )
    return ", ".join(parts)


@query(
    f"""WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS row_id, vec_id,
           list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
         WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
         cents0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS INTEGER) AS c, v AS cv
           FROM kept WHERE vec_id IS NOT NULL QUALIFY c < 16),
         {_assign_sql(3)}
       SELECT vec_id, best.c AS cluster, best.d AS distance,
         CAST(sum(best.d) OVER (PARTITION BY best.c) AS BIGINT) AS cluster_inertia, CAST(sum(best.d) OVER () AS BIGINT) AS inertia,
         sha256(array_to_string(cv, ',')) AS centroid_sha256
       FROM near3 JOIN cents3 ON c = best.c"""
)
def op11_centroids(spark: SparkSession, sf: str) -> DataFrame:
    """Nearest of 16 centroids of every vector, after three rounds."""
    out = clustering.cluster_vectors(table(spark, sf, "embeddings").select("vec_id", "embedding"))
    return out.select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", sha256(F.concat_ws(",", F.col("centroid").cast("array<string>"))).alias("centroid_sha256")
    )


@query()
def op12_whitening(spark: SparkSession, sf: str) -> DataFrame:
    """Whitened components of every vector."""
    out = whitening.whiten_vectors(table(spark, sf, "embeddings").select("vec_id", "embedding"))
    return out.withColumn("deviation", F.col("deviation").try_cast("bigint"))


@query()
def op13_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens of every document under a byte-level tokenizer."""
    import public_tokenizers

    docs = table(spark, sf, "documents").select("doc_id", "text")
    out = token_counts.with_token_counts(docs, public_tokenizers.path(TOKENIZER), TOKEN_LIMIT)
    return out.select("doc_id", "n_bytes", "n_tokens", "over_limit")
