"""Queries over text functions and row predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from bitexture.functions import predicates as P
from bitexture.functions import text as X
from bitexture.operators import corpus as C
from bitexture.operators.requests import resolve_same_language as resolve_rows
from bitexture.operators.requests import swap_languages as swap_rows
from bitexture.plans import inputs as I
from bitexture.plans.registry import query
from bitexture.sources.text import parse_tagged, tagged_line_stats as line_stats

q = I.with_inputs


def _dirty(column):
    def run(spark, sf):
        return I.dirty_lines(spark, sf).select("line_no", column(F.col("src")).alias("src"))

    return run


@query(q("SELECT line_no, nfc_normalize(src) AS src FROM dirty_lines", "dirty_lines"))
def nfc(spark, sf):
    return _dirty(X.nfc)(spark, sf)


@query(q(f"SELECT line_no, {I.sql_control('src')} AS src FROM dirty_lines", "dirty_lines"))
def strip_control(spark, sf):
    return _dirty(X.strip_control)(spark, sf)


@query(q(f"SELECT line_no, {I.sql_quotes('src')} AS src FROM dirty_lines", "dirty_lines"))
def ascii_quotes(spark, sf):
    return _dirty(X.ascii_quotes)(spark, sf)


@query(q(f"SELECT line_no, {I.sql_dashes('src')} AS src FROM dirty_lines", "dirty_lines"))
def ascii_dashes(spark, sf):
    return _dirty(X.ascii_dashes)(spark, sf)


@query(q(f"SELECT line_no, {I.sql_blanks('src')} AS src FROM dirty_lines", "dirty_lines"))
def collapse_blanks(spark, sf):
    return _dirty(X.collapse_blanks)(spark, sf)


@query(q(f"SELECT line_no, {I.sql_strip('src')} AS src FROM dirty_lines", "dirty_lines"))
def strip_unicode(spark, sf):
    return _dirty(X.strip_unicode)(spark, sf)


@query(q("SELECT line_no, lang, src, tgt FROM clean_pairs", "clean_pairs"))
def preprocess_text(spark, sf):
    return C.clean_pairs(I.dirty_pairs(spark, sf)).select("line_no", "lang", "src", "tgt")


@query(q("SELECT line_no, replace(src, chr(9), ' ') AS src FROM dirty_lines", "dirty_lines"))
def untab(spark, sf):
    return _dirty(X.untab)(spark, sf)


@query(
    q(
        """SELECT line_no, CASE lang WHEN 'de' THEN '<2de> ' WHEN 'fr' THEN '<2fr> ' ELSE '<2es> ' END || src AS src,
                  CASE lang WHEN 'de' THEN '<2de> ' ELSE '<2vi> ' END || src AS src_default FROM line_pairs""",
        "line_pairs",
    )
)
def tag_source(spark, sf):
    src, lang = F.col("src"), F.col("lang")
    return I.line_pairs(spark, sf).select(
        "line_no",
        X.tag_source(src, lang, I.TAGS).alias("src"),
        X.tag_source(src, lang, {"de": "<2de>"}, "<2vi>").alias("src_default"),
    )


@query(q(f"SELECT page_id, {I.sql_entities('text')} AS text FROM page_text", "page_text"))
def join_spaced_entities(spark, sf):
    return I.page_text(spark, sf).select("page_id", X.join_spaced_entities(F.col("text")).alias("text"))


@query(q(f"SELECT page_id, {I.sql_basic_unescape('html')} AS text FROM pages"))
def html_unescape_basic(spark, sf):
    return I.text_table(spark, sf, "pages").select("page_id", X.html_unescape(F.col("html"), full=False).alias("text"))


@query(
    q(
        rf"""SELECT line_no, regexp_replace(regexp_replace(src, '([.,])', ' ' || chr(160) || '\1', 'g'),
               '{I.WS_RE}+([.,!?;:''\"])', '\1', 'g') AS src FROM (SELECT *, line AS src FROM doc_lines)""",
        "doc_lines",
    )
)
def unspace_punct(spark, sf):
    spaced = F.regexp_replace("src", "([.,])", " \u00a0$1")
    return I.doc_lines(spark, sf).withColumnRenamed("line", "src").select("line_no", X.unspace_punct(spaced).alias("src"))


@query(
    q(
        rf"""SELECT line_no, regexp_replace(regexp_replace(src, '([aeiou])', '( ' || chr(160) || '[ \1', 'g'),
               '([\[(]){I.WS_RE}+', '\1', 'g') AS src FROM (SELECT *, line AS src FROM doc_lines)""",
        "doc_lines",
    )
)
def unspace_open_bracket(spark, sf):
    spaced = F.regexp_replace("src", "([aeiou])", "( \u00a0[ $1")
    return I.doc_lines(spark, sf).withColumnRenamed("line", "src").select("line_no", X.unspace_open_bracket(spaced).alias("src"))


@query(
    q("SELECT line_no, regexp_replace(replace(src, 'e', '   '), ' {2,}', ' ', 'g') AS src FROM (SELECT *, line AS src FROM doc_lines)", "doc_lines")
)
def collapse_double_space(spark, sf):
    spaced = F.replace("src", F.lit("e"), F.lit("   "))
    return I.doc_lines(spark, sf).withColumnRenamed("line", "src").select("line_no", X.collapse_double_space(spaced).alias("src"))


@query(q(f"SELECT page_id, {I.sql_clean_output('text')} AS text FROM page_text", "page_text"))
def clean_output(spark, sf):
    return I.page_text(spark, sf).select("page_id", X.clean_output(F.col("text"), full=False).alias("text"))


_NAMED = "replace(replace(replace(t, '&copy;', chr(169)), '&middot;', chr(183)), '&quot;', '\"')"


@query(
    q(
        f"""SELECT page_id, {I.sql_tidy(f"regexp_replace({_NAMED}, '&amp;?', '&', 'g')")} AS text
            FROM (SELECT page_id, {I.sql_entities('text')} AS t FROM page_text)""",
        "page_text",
    )
)
def clean_output_full(spark, sf):
    """The whole entity table; the SQL lists the entities the pages hold."""
    return I.page_text(spark, sf).select("page_id", X.clean_output(F.col("text")).alias("text"))


@query(
    f"""SELECT doc_id, unnest({I.sql_sentences('text')}) AS sentence,
          CAST(generate_subscripts({I.sql_sentences('text')}, 1) - 1 AS INTEGER) AS pos FROM documents"""
)
def split_sentences(spark, sf):
    docs = I.text_table(spark, sf, "documents")
    return docs.select("doc_id", F.posexplode(X.split_sentences(F.col("text"))).alias("pos", "sentence"))


@query(
    q(
        f"""SELECT req_id, CASE WHEN source_lang = 'en' THEN {I.sql_english('t')} ELSE t END AS source
            FROM (SELECT *, {I.sql_strip('source_text')} AS t FROM requests)""",
        "requests",
    )
)
def normalize_english(spark, sf):
    t = X.strip_unicode(F.col("source_text"))
    return I.requests(spark, sf).select("req_id", X.normalize_english(t, F.col("source_lang")).alias("source"))


@query(
    q(
        f"""SELECT req_id, CASE WHEN {I.sql_strip('source_text')} = '' THEN '{X.NO_TRANSLATION}'
              ELSE {I.sql_strip('source_text')} END AS text FROM requests""",
        "requests",
    )
)
def placeholder_if_empty(spark, sf):
    t = X.strip_unicode(F.col("source_text"))
    return I.requests(spark, sf).select("req_id", X.placeholder_if_empty(t).alias("text"))


@query(
    r"""SELECT conv_id, turn, n AS n_chars, n > 500 AS over_limit FROM (
          SELECT conv_id, turn, length(t) + length(regexp_replace(t, '[^\x{10000}-\x{10FFFF}]', '', 'g')) AS n FROM (
            SELECT *, CASE WHEN conv_id % 3 = 0 THEN replace(text, 'e', chr(128512)) ELSE text END AS t FROM conversations))"""
)
def char_limit(spark, sf):
    """Lengths as the page counts them; every third text has wide signs."""
    t = F.when(F.col("conv_id") % 3 == 0, F.replace("text", F.lit("e"), F.lit("\U0001f600"))).otherwise(F.col("text"))
    return I.table(spark, sf, "conversations").select(
        "conv_id", "turn", X.char_count(t).alias("n_chars"), X.over_limit(t).alias("over_limit")
    )


@query(
    """SELECT vec_id, CASE WHEN label = 3 THEN 0 ELSE vec_id END AS epoch FROM embeddings"""
)
def epoch_from_name(spark, sf):
    name = F.concat(
        F.lit("/models/transformer_ep"), F.when(F.col("label") == 3, "best").otherwise(F.col("vec_id").cast("string")), F.lit(".pt")
    )
    return I.table(spark, sf, "embeddings").select("vec_id", X.epoch_from_name(name).alias("epoch"))


@query(q("SELECT line_no, lang, src, tgt FROM judged_pairs WHERE reason IS NULL", "judged_pairs"))
def valid_pairs(spark, sf):
    return C.valid_pairs(I.dirty_pairs(spark, sf)).select("line_no", "lang", "src", "tgt")


@query(
    q(
        "SELECT lang, coalesce(reason, 'valid') AS reason, count(*) AS n FROM judged_pairs GROUP BY 1, 2", "judged_pairs"
    )
)
def invalid_reason(spark, sf):
    reason = F.coalesce(P.invalid_reason(F.col("src"), F.col("tgt")), F.lit("valid"))
    judged = C.clean_pairs(I.dirty_pairs(spark, sf)).select("lang", reason.alias("reason"))
    return judged.groupBy("lang", "reason").agg(F.count(F.lit(1)).alias("n"))


@query(
    q(
        f"""SELECT line_no, lang, count(*) AS n FROM line_pairs
            WHERE {I.sql_strip('src')} <> '' AND {I.sql_strip('tgt')} <> '' GROUP BY 1, 2""",
        "line_pairs",
    )
)
def non_empty_pairs(spark, sf):
    kept = I.line_pairs(spark, sf).where(P.non_empty_pair(F.col("src"), F.col("tgt")))
    return kept.groupBy("line_no", "lang").agg(F.count(F.lit(1)).alias("n"))


@query(
    q(
        f"""SELECT line_no, direction, strpos({I.sql_strip('value')}, chr(9)) > 0 AS has_tab,
                   {I.sql_strip('value')} <> '' AS non_blank FROM tagged_lines""",
        "tagged_lines",
    )
)
def line_filters(spark, sf):
    v = F.col("value")
    return I.tagged_lines(spark, sf).select(
        "line_no", "direction", P.has_tab(v).alias("has_tab"), P.non_blank_line(v).alias("non_blank")
    )


@query(
    q(
        """SELECT line_no, direction, src, tgt FROM parsed_lines
           WHERE strpos(l, chr(9)) > 0 AND src <> '' AND tgt <> ''""",
        "parsed_lines",
    )
)
def parse_tagged_lines(spark, sf):
    lines = I.tagged_lines(spark, sf)
    return (
        lines.select("line_no", "direction", parse_tagged(F.col("value")).alias("p"))
        .where("p.status = 'ok'")
        .select("line_no", "direction", "p.src", "p.tgt")
    )


@query(
    q(
        """SELECT count(*) FILTER (l <> '' AND strpos(l, chr(9)) > 0 AND src <> '' AND tgt <> '') AS good,
                  count(*) FILTER (l <> '' AND NOT coalesce(strpos(l, chr(9)) > 0 AND src <> '' AND tgt <> '', false)) AS bad,
                  count(*) FILTER (l = '') AS blank FROM parsed_lines""",
        "parsed_lines",
    )
)
def tagged_line_stats(spark, sf):
    return line_stats(I.tagged_lines(spark, sf))


_LISTED = "[''en'', ''de'', ''fr'', ''es'']"
SQL_STATUS = f"""CASE WHEN {I.sql_strip('source_text')} = '' THEN '{P.EMPTY_TEXT}'
    WHEN source_lang NOT IN ('en','de','fr','es') THEN '{P.BAD_SOURCE}{_LISTED}'
    WHEN target_lang NOT IN ('en','de','fr','es') THEN '{P.BAD_TARGET}{_LISTED}'
    WHEN source_lang = target_lang THEN '{P.SAME_LANGUAGE}' END"""


@query(
    q(
        f"""SELECT req_id, CAST(CASE WHEN detail IS NULL THEN 200 ELSE 400 END AS INTEGER) AS status, detail
            FROM (SELECT req_id, {SQL_STATUS} AS detail FROM requests)""",
        "requests",
    )
)
def validate_request(spark, sf):
    status, detail = P.validate_request(F.col("source_text"), F.col("source_lang"), F.col("target_lang"), I.LANGS)
    return I.requests(spark, sf).select("req_id", status.alias("status"), detail.alias("detail"))


@query(
    q(
        """SELECT req_id, NOT ((source_lang = 'en' AND target_lang IN ('de','fr','es'))
             OR (target_lang = 'en' AND source_lang IN ('de','fr','es'))) AS use_pivot FROM requests""",
        "requests",
    )
)
def route_request(spark, sf):
    pivot = P.use_pivot(F.col("source_lang"), F.col("target_lang"), P.direct_pairs(I.LANGS, "en"))
    return I.requests(spark, sf).select("req_id", pivot.alias("use_pivot"))


@query(
    q(
        """SELECT req_id, source_lang, CASE WHEN source_lang <> target_lang THEN target_lang
             WHEN source_lang = 'en' THEN 'de' ELSE 'en' END AS target_lang FROM requests""",
        "requests",
    )
)
def resolve_same_language(spark, sf):
    rows = I.requests(spark, sf).select("req_id", "source_lang", "target_lang")
    return resolve_rows(rows, I.LANGS)


@query(
    q(
        f"""SELECT req_id, target_lang AS source_lang, source_lang AS target_lang,
              CASE WHEN source_text <> '' AND out <> '' AND ok THEN out ELSE source_text END AS source_text
            FROM (SELECT *, CASE WHEN req_id % 3 = 0 THEN '' ELSE 'out ' || source_text END AS out,
                         req_id % 4 <> 0 AS ok FROM requests)""",
        "requests",
    )
)
def swap_languages(spark, sf):
    out = F.when(F.col("req_id") % 3 == 0, "").otherwise(F.concat(F.lit("out "), "source_text"))
    rows = I.requests(spark, sf).withColumns({"output_text": out, "output_ok": F.col("req_id") % 4 != 0})
    return swap_rows(rows).select("req_id", "source_lang", "target_lang", "source_text")
