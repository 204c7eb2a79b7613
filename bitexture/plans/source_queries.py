"""Queries that write derived rows to the shared folder and read them back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from bitexture.functions import predicates as P
from bitexture.operators import corpus as C
from bitexture.operators import bpe as B
from bitexture.operators import shuffle as S
from bitexture.operators import tokens as K
from bitexture.operators.requests import translate_batch as translate_rows
from bitexture.plans import inputs as I
from bitexture.plans.jobs import MAX_PAIRS
from bitexture.plans.jobs import evaluate as evaluate_pairs
from bitexture.plans.metric_queries import SQL_BEST_AND_WORST, SQL_CORPUS_BLEU
from bitexture.plans.registry import query
from bitexture.session import shared_dir
from bitexture.sources import artifacts as A
from bitexture.sources import records as R
from bitexture.sources import text as T
from bitexture.sources.tokenizers import read_tokenizer, write_tokenizer

q = I.with_inputs


def _folder(spark) -> str:
    return f"{shared_dir(spark).rstrip('/')}/sources-{uuid.uuid4().hex}"


def _records(spark, sf) -> str:
    """Dirty pairs as translation records, in line order over the files."""
    path = f"{_folder(spark)}/train"
    pairs = I.dirty_pairs(spark, sf).orderBy("line_no")
    pairs.select(F.struct(F.col("src").alias("en"), F.col("tgt").alias("xx")).alias("translation")).write.parquet(path)
    return path


_NUMBERED = "SELECT *, row_number() OVER (ORDER BY line_no) - 1 AS n FROM"


@query(q(f"SELECT n AS line_no, 'xx' AS lang, src, tgt FROM ({_NUMBERED} dirty_pairs)", "dirty_pairs"))
def read_translations(spark, sf):
    """Numbered pairs from records; the first of two paths is missing."""
    path = _records(spark, sf)
    return R.read_first_available(spark, [f"{path}-missing", path], "xx")[0]


@query(
    q(
        f"""SELECT n AS line_no, src, tgt FROM (
              SELECT *, row_number() OVER (ORDER BY n) AS k FROM ({_NUMBERED} judged_pairs) WHERE reason IS NULL)
            WHERE k <= {MAX_PAIRS}""",
        "judged_pairs",
    )
)
def cap_records(spark, sf):
    """Records, cleaned and capped at the default number of pairs."""
    pairs = R.read_translations(spark, _records(spark, sf), "xx")
    return C.cap_per_language(pairs, MAX_PAIRS).select("line_no", "src", "tgt")


@query(q(f"SELECT n AS line_no, src, tgt FROM ({_NUMBERED} line_pairs)", "line_pairs"))
def parallel_text_files(spark, sf):
    """Two aligned line files, written and read."""
    paths = T.write_parallel_text(I.line_pairs(spark, sf), _folder(spark), "en", "xx")
    return T.read_parallel_text(spark, *paths)


@query(
    q(
        f"""SELECT src, tgt, count(*) AS n FROM (SELECT {I.sql_strip('src')} AS src, {I.sql_strip('tgt')} AS tgt FROM both_ways)
            WHERE src <> '' AND tgt <> '' GROUP BY 1, 2""",
        "both_ways",
    )
)
def tagged_files(spark, sf):
    """Tagged lines in both directions, written and read."""
    path = f"{_folder(spark)}/tagged"
    T.write_tagged_tsv(C.both_directions(I.line_pairs(spark, sf), I.TAGS), path)
    pairs, _ = T.read_tagged_tsv(spark, path)
    return pairs.groupBy("src", "tgt").agg(F.count(F.lit(1)).alias("n"))


@query(
    q(
        f"""SELECT line_no, src, tgt FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY line_no) AS k FROM (
              SELECT line_no, lang, {I.sql_strip('src')} AS src, {I.sql_strip('tgt')} AS tgt FROM dirty_pairs)
              WHERE src <> '' AND tgt <> '') WHERE k <= 100""",
        "dirty_pairs",
    )
)
def cap_non_empty(spark, sf):
    """The first pairs of each language that are merely not empty."""
    out = C.cap_per_language(I.dirty_pairs(spark, sf), 100, C.stripped_pairs, C.non_empty())
    return out.select("line_no", "src", "tgt")


_VALUE = "src || chr(9) || tgt"
_SPLIT = """CASE WHEN rn <= floor(n * 0.85) THEN 'train' WHEN rn <= floor(n * 0.85) + floor(n * 0.10) THEN 'val' ELSE 'test' END"""


def _read_splits(spark, paths):
    parts = [spark.read.text(p).select(F.lit(s).alias("split"), "value") for s, p in paths.items()]
    return C.union_languages(*parts).groupBy("split", "value").agg(F.count(F.lit(1)).alias("n"))


@query(
    q(
        f"""SELECT split, value, count(*) AS n FROM (SELECT {_VALUE} AS value, {_SPLIT} AS split FROM (
              SELECT *, count(*) OVER () AS n, row_number() OVER (ORDER BY md5('42:' || line_no), line_no) AS rn FROM line_pairs))
            GROUP BY 1, 2""",
        "line_pairs",
    )
)
def split_files(spark, sf):
    """Splits of the pairs' lines, written and read."""
    lines = I.line_pairs(spark, sf).select("line_no", C.tagged_line().alias("value"))
    return _read_splits(spark, T.write_splits(S.split_exact(lines, ["line_no"]), _folder(spark)))


@query(
    q(
        f"""SELECT split, value, count(*) AS n, true AS reused FROM (SELECT value, {_SPLIT} AS split FROM (
              SELECT *, count(*) OVER () AS n, row_number() OVER (ORDER BY md5('42:' || k), k) AS rn FROM (
                SELECT {_VALUE} AS value, row_number() OVER (ORDER BY line_no) - 1 AS k FROM line_pairs)
              WHERE {I.sql_strip('value')} <> '')) GROUP BY 1, 2""",
        "line_pairs",
    )
)
def reuse_or_split(spark, sf):
    """A file of lines, split at the first call; the second finds the split."""
    folder = _folder(spark)
    lines = I.line_pairs(spark, sf).orderBy("line_no").select(C.tagged_line().alias("value"))
    lines.write.text(f"{folder}/lines")
    T.reuse_or_split(spark, f"{folder}/lines", f"{folder}/splits")
    paths, reused = T.reuse_or_split(spark, f"{folder}/lines", f"{folder}/splits")
    return _read_splits(spark, paths).withColumn("reused", F.lit(reused))


@query(
    q(
        """SELECT lang AS name, true AS present, round(sum(strlen(line) + 1) / 1e6, 1) AS mb FROM doc_lines GROUP BY 1
           UNION ALL SELECT 'missing', false, NULL""",
        "doc_lines",
    )
)
def input_manifest(spark, sf):
    """Which of the files of each language are there, and how large."""
    folder = _folder(spark)
    I.doc_lines(spark, sf).select("line", "lang").write.partitionBy("lang").text(folder)
    langs = [r.lang for r in I.table(spark, sf, "documents").select("lang").distinct().collect()]  # few
    required = {lang: f"{folder}/lang={lang}" for lang in langs} | {"missing": f"{folder}/lang=missing"}
    return A.input_manifest(spark, required).select("name", "present", "mb")


@query(
    q(
        """SELECT 'transformer_ep' || epoch || '.pt' AS name, strlen(string_agg(n_batches || chr(10), '')) AS length, epoch
           FROM runs GROUP BY epoch""",
        "runs",
    )
)
def list_artifacts(spark, sf):
    """One file per epoch, named as training names them."""
    base = _folder(spark)
    lines = I.runs(spark, sf).select(F.col("n_batches").cast("string"), "epoch")
    lines.repartition(1, "epoch").write.partitionBy("epoch").text(base)
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(base).getFileSystem(spark._jsc.hadoopConfiguration())
    for part in files.globStatus(path(f"{base}/epoch=*/part-*")):  # an epoch's one file
        epoch = part.getPath().getParent().getName().split("=")[1]
        files.rename(part.getPath(), path(f"{base}/transformer_ep{epoch}.pt"))
    return A.list_artifacts(spark, f"{base}/transformer_ep*.pt")


@query(
    q(
        """SELECT epoch, round(coalesce(val, 0), 6) AS val, round(coalesce(train, 0), 6) AS train, 0.0::DOUBLE AS lr FROM runs""",
        "runs",
    )
)
def read_run_history(spark, sf):
    """Checkpoint records of all runs; some lines can't be read."""
    path = _folder(spark)
    record = F.to_json(F.struct("epoch", F.col("val").alias("val_loss"), F.col("train").alias("train_loss")))
    broken = F.concat(F.lit("{"), F.col("run_id"))
    I.runs(spark, sf).select(F.explode(F.array(record, broken)).alias("value")).write.text(path)
    out = R.read_run_history(spark, path)
    return out.select("epoch", F.round("val", 6).alias("val"), F.round("train", 6).alias("train"), "lr")


@query(q("SELECT token, id, (SELECT count(*) FROM vocab) AS vocab_size, 2 AS pad_bos_eos FROM vocab", "vocab"))
def tokenizer_tables(spark, sf):
    """A vocabulary of words, written as a tokenizer and read."""
    folder, specials = _folder(spark), K.SPECIAL_TOKENS[:4]
    none = spark.createDataFrame([], "rank int, left string, right string, merged string")
    write_tokenizer(B.BpeModel(I.vocab(spark, sf), none, specials), folder, 2, "documents")
    tokenizer = B.Tokenizer(read_tokenizer(spark, folder))
    size = F.lit(tokenizer.vocab_size).cast("bigint")
    marks = F.lit(tokenizer.eos_id - tokenizer.bos_id + 1 + tokenizer.pad_id).cast("int")
    return tokenizer.model.vocab.select("token", "id", size.alias("vocab_size"), marks.alias("pad_bos_eos"))


def _swap_words():
    return lambda text: text.replace("the", "that").upper().replace("E", "3")


@query(
    q(
        """SELECT line_no, replace(upper(replace(line, 'the', 'that')), 'E', '3') AS hyp FROM doc_lines WHERE NOT regexp_matches(line, '[^ -~]')""",
        "doc_lines",
    )
)
def translate_batch(spark, sf):
    """A caller's text function over all ASCII lines."""
    lines = I.doc_lines(spark, sf).where(~F.col("line").rlike("[^ -~]")).select("line_no", "line")
    return translate_rows(lines, _swap_words, "line").select("line_no", "hyp")


def _drop_words():
    return lambda text: " ".join(w for i, w in enumerate(text.split(" ")) if i % I.OMIT_EVERY != I.OMIT_EVERY - 1)


def _evaluation(spark, sf):
    lines = I.hypotheses(spark, sf).select("id", F.col("ref").alias("src"), F.col("ref").alias("tgt"))
    return evaluate_pairs(lines, _drop_words, "none")


@query(SQL_CORPUS_BLEU)
def evaluate_corpus(spark, sf):
    """Corpus BLEU of a translator that leaves out every fourth word."""
    return _evaluation(spark, sf).corpus.withColumn("bleu", F.round("bleu", 6))


@query(
    f"""SELECT side, score FROM ({SQL_BEST_AND_WORST})"""
)
def evaluate_sentences(spark, sf):
    """Scores of the best and worst sentences of that translator."""
    found = _evaluation(spark, sf)
    both = found.best.select(F.lit("best").alias("side"), "score").unionByName(found.worst.select(F.lit("worst").alias("side"), "score"))
    return both.withColumn("score", F.round("score", 6))


@query(
    q(
        """SELECT coalesce(detail, 'ok') AS detail, count(*) AS n FROM (
             SELECT CASE WHEN conv_id % 10 = 0 THEN 'source_text không được để trống.'
               ELSE 'source_lang không hợp lệ: [''Tiếng Việt'', ''Tiếng Nhật'', ''Tiếng Trung'', ''Tiếng Anh'']' END AS detail
             FROM conversations) GROUP BY 1"""
    )
)
def default_request_languages(spark, sf):
    """What the default languages say about requests in other languages."""
    requests = I.requests(spark, sf)
    _, detail = P.validate_request(F.col("source_text"), F.col("source_lang"), F.col("target_lang"))
    return requests.groupBy(F.coalesce(detail, F.lit("ok")).alias("detail")).agg(F.count(F.lit(1)).alias("n"))
