"""Queries over corpus operators: caps, directions, shuffles, splits, joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from bitexture.functions import predicates as P
from bitexture.operators import corpus as C
from bitexture.operators import lookup as J
from bitexture.operators import shuffle as S
from bitexture.operators.requests import translate_documents as translate_rows
from bitexture.operators.requests import clean_memory, process_requests as process_rows
from bitexture.plans import inputs as I
from bitexture.plans.jobs import build_corpus as build_corpus_rows
from bitexture.plans.registry import query
from bitexture.plans.text_queries import SQL_STATUS

q = I.with_inputs
CAP = 100


@query(
    q(
        f"""SELECT line_no, lang, src, tgt FROM (
              SELECT *, row_number() OVER (PARTITION BY lang ORDER BY line_no) AS rn FROM judged_pairs WHERE reason IS NULL)
            WHERE rn <= {CAP}""",
        "judged_pairs",
    )
)
def cap_per_language(spark, sf):
    return C.cap_per_language(I.dirty_pairs(spark, sf), CAP).select("line_no", "lang", "src", "tgt")


@query(
    q(
        f"""SELECT lang, count(*) AS raw, count(*) FILTER (reason IS NULL) AS valid,
                   count(*) FILTER (reason IS NOT NULL) AS skipped
            FROM (SELECT *, coalesce(sum(CASE WHEN reason IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY lang ORDER BY line_no
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM judged_pairs)
            WHERE before < {CAP} GROUP BY 1""",
        "judged_pairs",
    )
)
def load_stats(spark, sf):
    return C.load_stats(I.dirty_pairs(spark, sf), CAP)


@query(
    q(
        """SELECT coalesce(lang, 'TOTAL') AS lang, count(*) AS pairs FROM judged_pairs WHERE reason IS NULL
           GROUP BY ROLLUP (lang)""",
        "judged_pairs",
    )
)
def pair_summary(spark, sf):
    return C.pair_summary(C.valid_pairs(I.dirty_pairs(spark, sf)))


@query(q("SELECT line_no, lang, direction, src, tgt FROM both_ways", "both_ways"))
def both_directions(spark, sf):
    return C.both_directions(I.line_pairs(spark, sf), I.TAGS)


@query(q("SELECT lang, count(*) AS n, sum(length(src)) AS src_chars FROM line_pairs GROUP BY 1", "line_pairs"))
def union_languages(spark, sf):
    pairs = I.line_pairs(spark, sf)
    parts = [pairs.where(F.col("lang") == lang) for lang in I.TAGS]
    return (
        C.union_languages(*parts)
        .groupBy("lang")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("src")).alias("src_chars"))
    )


def _sql_shuffled(seed):
    return f"""SELECT line_no, row_number() OVER (ORDER BY md5('{seed}:' || line_no), line_no) - 1 AS row_idx
               FROM line_pairs"""


@query(q(_sql_shuffled("42"), "line_pairs"))
def seeded_shuffle(spark, sf):
    """Position of each pair in the shuffled corpus."""
    return S.shuffled_index(I.line_pairs(spark, sf).select("line_no"), ["line_no"], "42")


@query(q(_sql_shuffled("42/3"), "line_pairs"))
def epoch_shuffle(spark, sf):
    return S.shuffled_index(I.line_pairs(spark, sf).select("line_no"), ["line_no"], S.epoch_seed("42", 3))


_SQL_SPLIT = """CASE WHEN rn <= floor(n * 0.85) THEN 'train' WHEN rn <= floor(n * 0.85) + floor(n * 0.10) THEN 'val'
                ELSE 'test' END AS split"""


@query(
    q(
        f"""SELECT line_no, direction, {_SQL_SPLIT} FROM (
              SELECT line_no, direction, count(*) OVER () AS n,
                     row_number() OVER (ORDER BY md5('42:' || line_no || ':' || direction), line_no, direction) AS rn
              FROM both_ways)""",
        "both_ways",
    )
)
def split_exact(spark, sf):
    rows = C.both_directions(I.line_pairs(spark, sf), I.TAGS).select("line_no", "direction")
    return S.split_exact(rows, ["line_no", "direction"])


@query(
    q(
        f"""SELECT line_no, direction, split FROM both_ways JOIN (
              SELECT line_no, {_SQL_SPLIT} FROM (
                SELECT line_no, count(*) OVER () AS n, row_number() OVER (ORDER BY md5('42:' || line_no), line_no) AS rn
                FROM line_pairs)) USING (line_no)""",
        "both_ways",
    )
)
def split_exact_grouped(spark, sf):
    """Both directions of a pair land in the same split."""
    rows = C.both_directions(I.line_pairs(spark, sf), I.TAGS).select("line_no", "direction")
    return S.split_exact(rows, ["line_no", "direction"], group=["line_no"])


@query(
    q(
        """SELECT line_no, direction, CASE WHEN u < 0.85 THEN 'train' WHEN u < 0.95 THEN 'val' ELSE 'test' END AS split
           FROM (SELECT line_no, direction,
                        CAST('0x' || substr(md5('42:' || line_no), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM both_ways)""",
        "both_ways",
    )
)
def split_hash(spark, sf):
    rows = C.both_directions(I.line_pairs(spark, sf), I.TAGS).select("line_no", "direction")
    return S.split_hash(rows, ["line_no", "direction"], group=["line_no"])


@query(
    q(
        f"""SELECT split, count(*) AS n_rows, CAST(ceil(count(*) / 64.0) AS BIGINT) AS n_batches FROM (
              SELECT {_SQL_SPLIT} FROM (SELECT count(*) OVER () AS n,
                row_number() OVER (ORDER BY md5('42:' || line_no), line_no) AS rn FROM line_pairs)) GROUP BY 1""",
        "line_pairs",
    )
)
def split_summary(spark, sf):
    return S.split_summary(S.split_exact(I.line_pairs(spark, sf).select("line_no"), ["line_no"]))


@query(
    q(
        f"SELECT line_no, row_idx, CAST(floor(row_idx / 64) AS BIGINT) AS batch_id FROM ({_sql_shuffled('42/1')})",
        "line_pairs",
    )
)
def assign_batches(spark, sf):
    """Batches of one training epoch."""
    rows = S.shuffled_index(I.line_pairs(spark, sf).select("line_no"), ["line_no"], S.epoch_seed("42", 1))
    return S.assign_batches(rows)


@query(
    q(
        """SELECT batch_id, count(*) AS n, min(line_no) AS first_line, max(line_no) AS last_line FROM (
             SELECT line_no, CAST(floor((row_number() OVER (ORDER BY line_no) - 1) / 64) AS BIGINT) AS batch_id
             FROM line_pairs) GROUP BY 1""",
        "line_pairs",
    )
)
def file_order_batches(spark, sf):
    """Batches of the unshuffled splits, in line order."""
    rows = S.file_order_index(I.line_pairs(spark, sf).select("line_no"), "line_no")
    return (
        S.assign_batches(rows)
        .groupBy("batch_id")
        .agg(
            F.count(F.lit(1)).alias("n"), F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line")
        )
    )


@query(
    q(
        """SELECT line_no, src, tgt FROM (
             SELECT *, row_number() OVER (ORDER BY line_no) AS rn FROM line_pairs) WHERE rn <= 64""",
        "line_pairs",
    )
)
def first_batch(spark, sf):
    return S.first_batch(I.line_pairs(spark, sf), "line_no").select("line_no", "src", "tgt")


@query(
    q(
        """SELECT req_id, CASE source_lang WHEN 'en' THEN '<2en>' WHEN 'de' THEN '<2de>' ELSE '<2vi>' END AS tag
           FROM requests""",
        "requests",
    )
)
def lookup_tag(spark, sf):
    from bitexture.functions.text import tag_for

    tag = tag_for(F.col("source_lang"), {"en": "<2en>", "de": "<2de>"}, "<2vi>")
    return I.requests(spark, sf).select("req_id", tag.alias("tag"))


@query(
    q(
        """SELECT req_id, 'direct' AS route FROM requests WHERE (source_lang, target_lang) IN
             (('en','de'), ('en','fr'), ('en','es'), ('de','en'), ('fr','en'), ('es','en'))
           UNION ALL
           SELECT req_id, 'other' FROM requests WHERE (source_lang, target_lang) NOT IN
             (('en','de'), ('en','fr'), ('en','es'), ('de','en'), ('fr','en'), ('es','en'))""",
        "requests",
    )
)
def language_sets(spark, sf):
    rows = I.requests(spark, sf).select("req_id", "source_lang", "target_lang")
    pairs, cols = P.direct_pairs(I.LANGS, "en"), ["source_lang", "target_lang"]
    direct = J.in_set(rows, pairs, cols).select("req_id", F.lit("direct").alias("route"))
    other = J.not_in_set(rows, pairs, cols).select("req_id", F.lit("other").alias("route"))
    return direct.unionByName(other)


@query(
    q(
        """SELECT e.line_no, e.line AS src, x.line AS tgt FROM doc_lines e
           JOIN doc_lines x ON x.doc_id = e.doc_id + 1 AND x.pos = e.pos""",
        "doc_lines",
    )
)
def zip_lines(spark, sf):
    """Lines of neighbouring documents zipped by number, to the shorter end."""
    lines = I.doc_lines(spark, sf)
    a = lines.select("line_no", F.col("line").alias("src"))
    b = lines.select((F.col("line_no") - I.LINES_PER_DOC).alias("line_no"), F.col("line").alias("tgt"))
    return J.zip_lines(a, b)


@query(q("SELECT id, hyp, ref FROM hypotheses", "hypotheses"))
def zip_eval(spark, sf):
    rows = I.hypotheses(spark, sf)
    return J.zip_eval(rows.select("id", "hyp"), rows.select("id", "ref"))


@query(
    q(
        f"""SELECT a.src_lang, a.text, a.english, b.tgt_lang, b.translation FROM
              (SELECT lang AS src_lang, tgt AS text, min({I.sql_clean('src')}) AS english FROM sentence_pairs GROUP BY 1, 2) a
            JOIN (SELECT lang AS tgt_lang, {I.sql_clean('src')} AS english, min(tgt) AS translation
                  FROM sentence_pairs GROUP BY 1, 2) b
              ON a.english = b.english AND a.src_lang <> b.tgt_lang""",
        "sentence_pairs",
    )
)
def pivot_pairs(spark, sf):
    pairs = I.sentence_pairs(spark, sf)
    to_english = pairs.select(F.col("lang").alias("src_lang"), F.col("tgt").alias("text"), F.col("src").alias("english"))
    from_english = pairs.select(
        F.col("lang").alias("tgt_lang"), F.col("src").alias("english"), F.col("tgt").alias("translation")
    )
    return C.pivot_pairs(to_english, from_english)


@query(q("SELECT src_lang, tgt_lang, src, tgt FROM memory", "memory"))
def translation_memory(spark, sf):
    return I.memory(spark, sf)


def _sql_translate(rows, key):
    """Joined translations of ``rows (key, src_lang, tgt_lang, text)``."""
    return f"""SELECT {key}, coalesce(string_agg(t, ' ' ORDER BY pos) FILTER (t <> ''), '') AS translated FROM (
        SELECT r.{key}, s.pos, m.tgt AS t FROM {rows} r
        LEFT JOIN (SELECT {key}, unnest({I.sql_sentences('text')}) AS sent,
                     generate_subscripts({I.sql_sentences('text')}, 1) AS pos FROM {rows}) s ON s.{key} = r.{key}
        LEFT JOIN tidy_memory m ON m.src_lang = r.src_lang AND m.tgt_lang = r.tgt_lang AND m.src = s.sent) GROUP BY 1"""


@query(
    q(
        "SELECT * FROM (" + _sql_translate("docs", "doc_id") + ")",
        "tidy_memory",
    ).replace(
        "SELECT * FROM (SELECT doc_id, coalesce",
        ", docs AS (SELECT doc_id, lang AS src_lang, 'en' AS tgt_lang, text FROM documents WHERE lang <> 'en')\n"
        "SELECT * FROM (SELECT doc_id, coalesce",
    )
)
def translate_documents(spark, sf):
    """Every document in another language, into English, by sentences."""
    docs = I.text_table(spark, sf, "documents").where(F.col("lang") != "en")
    docs = docs.select("doc_id", F.col("lang").alias("src_lang"), F.lit("en").alias("tgt_lang"), "text")
    return translate_rows(docs, clean_memory(I.memory(spark, sf))).select("doc_id", "translated")


_CHECKED = f"""checked AS MATERIALIZED (SELECT req_id, source_lang, target_lang, {SQL_STATUS} AS detail,
      CASE WHEN source_lang = 'en' THEN {I.sql_english(I.sql_strip('source_text'))} ELSE {I.sql_strip('source_text')} END AS text,
      source_lang <> 'en' AND target_lang <> 'en' AS indirect FROM line_requests)"""
_HOP1 = """hop1 AS MATERIALIZED (SELECT req_id, source_lang AS src_lang, indirect, target_lang AS final_lang,
      CASE WHEN indirect THEN 'en' ELSE target_lang END AS tgt_lang, text FROM checked WHERE detail IS NULL)"""
_HOP2 = """hop2 AS MATERIALIZED (SELECT req_id, 'en' AS src_lang, final_lang AS tgt_lang, translated AS text
      FROM hop1 JOIN first_hop USING (req_id) WHERE indirect)"""
_PROCESS = f"""SELECT c.req_id, source_lang, target_lang, CAST(CASE WHEN detail IS NULL THEN 200 ELSE 400 END AS INTEGER) AS status,
      detail, CASE WHEN detail IS NULL THEN 'Transformer' END AS model, detail IS NULL AND c.indirect AS "pivot",
      CASE WHEN detail IS NULL THEN CASE WHEN coalesce(r.t, '') = '' THEN '[Không thể dịch]' ELSE r.t END END AS translated_text
    FROM checked c LEFT JOIN (
      SELECT req_id, translated AS t FROM hop1 JOIN first_hop USING (req_id) WHERE NOT indirect
      UNION ALL SELECT req_id, translated FROM second_hop) r USING (req_id)"""


@query(
    q("SELECT @", "tidy_memory", "line_requests").replace(
        "SELECT @",
        f""", {_CHECKED}, {_HOP1}, first_hop AS MATERIALIZED ({_sql_translate('hop1', 'req_id')}),
        {_HOP2}, second_hop AS MATERIALIZED ({_sql_translate('hop2', 'req_id')}) {_PROCESS}""",
    )
)
def process_requests(spark, sf):
    return process_rows(I.line_requests(spark, sf), I.memory(spark, sf), I.LANGS, "en")


@query(
    q(
        f"""SELECT line_no, direction, row_number() OVER (ORDER BY md5('42:' || line_no || ':' || direction), line_no, direction) - 1
              AS row_idx, value FROM (
              SELECT line_no, 0 AS direction, '<2' || lang || '> ' || src || chr(9) || tgt AS value FROM capped
              UNION ALL SELECT line_no, 1, '<2en> ' || tgt || chr(9) || src FROM capped)""",
        "judged_pairs",
    ).replace(
        "SELECT line_no, direction, row_number()",
        f""", capped AS (SELECT line_no, lang, src, tgt FROM (
          SELECT *, row_number() OVER (PARTITION BY lang ORDER BY line_no) AS rn FROM judged_pairs WHERE reason IS NULL)
          WHERE rn <= {CAP}) SELECT line_no, direction, row_number()""",
        1,
    )
)
def build_corpus(spark, sf):
    """Clean, validate, cap, double, shuffle: the training lines and their
    place in the file."""
    lines = build_corpus_rows([I.dirty_pairs(spark, sf)], CAP, I.TAGS)
    return S.shuffled_index(lines, ["line_no", "direction"]).select("line_no", "direction", "row_idx", "value")
