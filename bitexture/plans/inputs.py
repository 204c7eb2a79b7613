"""Inputs of the registered queries, derived by Spark from the given tables,
and the same inputs as SQL common table expressions.

No parallel corpus is supplied, so sentence pairs come from neighbouring
documents: an English document and the next one in another language, line by
line. The join is on the unique document number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitexture.functions import text as X
from bitexture.operators.corpus import both_directions, tagged_line, translation_memory
from bitexture.operators.tokens import bigram_scores, build_vocab, pretokenize, vocab_lookup, word_freq
from bitexture.sources.spread import spread

TAGS = {"de": "<2de>", "fr": "<2fr>", "es": "<2es>"}
LANGS = ("en", "de", "fr", "es")
LINES_PER_DOC = 1 << 32
TURNS_PER_CONV = 1 << 32
VOCAB = 2_000
OMIT_EVERY = 4


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def text_table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table whose text takes most of the work."""
    return spread(table(spark, sf, name))


def doc_lines(spark: SparkSession, sf: str) -> DataFrame:
    """``line_no, lang, line``: every line of every document."""
    d = text_table(spark, sf, "documents")
    return d.select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("pos", "line")).select(
        (F.col("doc_id") * LINES_PER_DOC + F.col("pos")).alias("line_no"), "lang", "line"
    )


def line_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """``line_no, lang, src, tgt``."""
    d = text_table(spark, sf, "documents")
    en = d.where(F.col("lang") == "en").select(
        (F.col("doc_id") + 1).alias("doc_id"), F.split("text", "\n").alias("src")
    )
    xx = d.where(F.col("lang") != "en").select("doc_id", "lang", F.split("text", "\n").alias("tgt"))
    zipped = F.posexplode(F.arrays_zip("src", "tgt"))
    return (
        en.join(xx, "doc_id")
        .select("doc_id", "lang", zipped.alias("pos", "p"))
        .where(F.col("p.src").isNotNull() & F.col("p.tgt").isNotNull())
        .select((F.col("doc_id") * LINES_PER_DOC + F.col("pos")).alias("line_no"), "lang", "p.src", "p.tgt")
    )


def dirty_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Line pairs whose source carries the damage the cleaning repairs."""
    return line_pairs(spark, sf).withColumn("src", _damaged())


def dirty_lines(spark: SparkSession, sf: str) -> DataFrame:
    """``line_no, lang, src``: every line of every document, damaged likewise."""
    return doc_lines(spark, sf).withColumnRenamed("line", "src").withColumn("src", _damaged())


def _damaged():
    s = F.col("src")
    kind = F.col("line_no") % 8
    return (
        F.when(kind == 0, F.concat(F.lit("“"), s, F.lit("”  «x»")))
        .when(kind == 1, F.concat(s, F.lit("\u200b\u0001")))
        .when(kind == 2, F.concat(F.lit("  "), s, F.lit("\t\t  end ")))
        .when(kind == 3, F.concat(F.lit("e\u0301 "), s))
        .when(kind == 4, F.concat(s, F.lit(" \u2014 \u2012")))
        .when(kind == 5, F.concat(F.lit("#"), s))
        # shorter before composition than after it
        .when(kind == 6, "\ufb2c")
        .otherwise("\u0958\u0958")
    )


def tagged_lines(spark: SparkSession, sf: str) -> DataFrame:
    """``line_no, direction, value``: both directions as file lines; every 17th
    lacks its TAB, every 19th its target, every 23rd is blank."""
    both = both_directions(line_pairs(spark, sf), TAGS)
    n = F.col("line_no")
    value = (
        F.when(n % 17 == 0, F.concat("src", F.lit(" "), "tgt"))
        .when(n % 19 == 0, F.concat("src", F.lit("\t ")))
        .when(n % 23 == 0, F.lit(" \t "))
        .otherwise(F.concat(F.lit("  "), tagged_line()))
    )
    return both.select("line_no", "direction", value.alias("value"))


def runs(spark: SparkSession, sf: str) -> DataFrame:
    """``run_id, epoch, train, val, n_batches``: one run per event type, one
    epoch per day, losses from the values of even and odd users."""
    e = table(spark, sf, "events")
    even = F.col("user_id") % 2 == 0
    return e.groupBy(F.col("event_type").alias("run_id"), F.dayofmonth("ts").cast("bigint").alias("epoch")).agg(
        _exact_mean(F.when(even, F.col("value"))).alias("train"),
        _exact_mean(F.when(~even, F.col("value"))).alias("val"),
        F.count(F.lit(1)).alias("n_batches"),
    )


def _exact_mean(value):
    """Mean of amounts with two decimals; the sum does not depend on order."""
    return F.sum(value.cast("decimal(18,2)")).cast("double") / F.count(value)


def batch_losses(spark: SparkSession, sf: str) -> DataFrame:
    """``run_id, n, loss``: each event is a batch, numbered by event id."""
    return table(spark, sf, "events").select(
        F.col("event_type").alias("run_id"), F.col("event_id").alias("n"), F.col("value").cast("decimal(18,2)").alias("loss")
    )


def token_scores(spark: SparkSession, sf: str) -> DataFrame:
    """``batch_id, pos, target, logprob, mean_logprob``; target 0 is padding."""
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("batch_id"),
        F.col("l_linenumber").alias("pos"),
        (F.col("l_partkey") % 5).cast("int").alias("target"),
        (-F.log(1 + F.col("l_quantity"))).alias("logprob"),
        (-(1 + F.col("l_discount"))).alias("mean_logprob"),
    )


def parameters(spark: SparkSession, sf: str) -> DataFrame:
    """``ckpt, name, values``."""
    return table(spark, sf, "embeddings").select(
        (F.col("vec_id") % 5).alias("ckpt"),
        F.concat(F.lit("layer"), F.col("label").cast("string")).alias("name"),
        F.col("embedding").alias("values"),
    )


def hypotheses(spark: SparkSession, sf: str) -> DataFrame:
    """``id, hyp, ref``: a line, and the line without every fourth word."""
    lines = doc_lines(spark, sf).where(F.trim("line") != "")
    words = F.split("line", " ")
    kept = F.filter(words, lambda w, i: i % OMIT_EVERY != OMIT_EVERY - 1)
    return lines.select(F.col("line_no").alias("id"), F.array_join(kept, " ").alias("hyp"), F.col("line").alias("ref"))


def requests(spark: SparkSession, sf: str) -> DataFrame:
    """``req_id, source_text, source_lang, target_lang`` from conversation
    turns: some texts blank, some languages unknown."""
    return as_requests(table(spark, sf, "conversations"))


def as_requests(turns: DataFrame) -> DataFrame:
    langs = F.array(*[F.lit(x) for x in (*LANGS, "xx")])
    blank = F.col("conv_id") % 10 == 0
    return turns.select(
        (F.col("conv_id") * TURNS_PER_CONV + F.col("turn")).alias("req_id"),
        F.when(blank, F.lit(" \u00a0\n")).otherwise(F.concat(F.lit(" i "), "text", F.lit(" i"))).alias("source_text"),
        F.element_at(langs, (F.col("conv_id") % 5 + 1).cast("int")).alias("source_lang"),
        F.element_at(langs, (F.col("turn") % 5 + 1).cast("int")).alias("target_lang"),
    )


def sentence_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """``lang, src, tgt``: line pairs cut into sentences, paired by position."""
    zipped = F.explode(F.arrays_zip(X.split_sentences(F.col("src")).alias("src"), X.split_sentences(F.col("tgt")).alias("tgt")))
    return (
        line_pairs(spark, sf)
        .select("lang", zipped.alias("p"))
        .where(F.col("p.src").isNotNull() & F.col("p.tgt").isNotNull())
        .select("lang", "p.src", "p.tgt")
    )


def memory(spark: SparkSession, sf: str) -> DataFrame:
    """``src_lang, tgt_lang, src, tgt``: both directions, unique per source.
    English sources are stored in the form requests are normalized to."""
    pairs = sentence_pairs(spark, sf)
    en = F.lit("en")
    first_upper = X.normalize_english(F.col("src"), en, "en")
    forth = translation_memory(pairs.select("lang", first_upper.alias("src"), "tgt"))
    back = translation_memory(pairs.select("lang", F.col("tgt").alias("src"), first_upper.alias("tgt")))
    return forth.select(en.alias("src_lang"), F.col("lang").alias("tgt_lang"), "src", "tgt").unionByName(
        back.select(F.col("lang").alias("src_lang"), en.alias("tgt_lang"), "src", "tgt")
    )


def line_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Requests whose texts are corpus lines: from English where the line
    number is even, else to English or to a third language."""
    third = F.element_at(F.create_map(*[F.lit(x) for x in ("de", "fr", "fr", "es", "es", "de")]), F.col("lang"))
    kind = F.col("line_no") % 3
    return line_pairs(spark, sf).select(
        F.col("line_no").alias("req_id"),
        F.when(kind == 0, F.col("src")).otherwise(F.col("tgt")).alias("source_text"),
        F.when(kind == 0, F.lit("en")).otherwise(F.col("lang")).alias("source_lang"),
        F.when(kind == 0, F.col("lang")).when(kind == 1, F.lit("en")).otherwise(third).alias("target_lang"),
    )


def vocab(spark: SparkSession, sf: str) -> DataFrame:
    return build_vocab(word_freq(doc_lines(spark, sf), "line"), VOCAB)


def line_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return doc_lines(spark, sf).select("line_no", "lang", pretokenize(F.col("line")).alias("tokens"))


def line_ids(spark: SparkSession, sf: str) -> DataFrame:
    """``line_no, lang, ids`` over the vocabulary of all lines."""
    return vocab_lookup(line_tokens(spark, sf), vocab(spark, sf))


def bigrams(spark: SparkSession, sf: str) -> DataFrame:
    return bigram_scores(line_ids(spark, sf))


def document_bigrams_of(ids: DataFrame, beams: DataFrame | None = None) -> DataFrame:
    """``src_id, prev, next, n, logprob``: bigrams within each document; with
    ``beams`` those that continue one of the document's beams."""
    doc = F.floor(F.col("line_no") / LINES_PER_DOC).cast("bigint").alias("src_id")
    # a document was one row, so its lines fit a task: they are placed by
    # document once, and no bigram is shuffled
    placed = ids.select(doc, "ids").repartition("src_id")
    if beams is None:
        return bigram_scores(placed, keys=["src_id"])
    last = beams.groupBy("src_id").agg(F.collect_set(F.element_at("tokens", -1)).alias("__after"))
    return bigram_scores(placed.join(last, "src_id"), keys=["src_id"], after="__after")


def page_text(spark: SparkSession, sf: str) -> DataFrame:
    """``page_id, text``: page text with entities spaced out, as a model that
    splits punctuation writes them."""
    t = F.regexp_replace("html", "<[^>]*>", " ")
    return text_table(spark, sf, "pages").select("page_id", F.regexp_replace(t, "&([a-z]+);", "& $1 ;").alias("text"))


# --- the same inputs in SQL -------------------------------------------------

_LANG_LIST = "['en','de','fr','es','xx']"


def sql_strip(x: str) -> str:
    return f"trim({x}, {_ws_literal()})"


def _ws_literal() -> str:
    return "(" + " || ".join(f"chr({ord(c)})" for c in X.WHITESPACE) + ")"


WS_RE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
CTRL_RE = r"[\x00-\x08\x0b-\x1f\x7f-\x{9f}\p{Cf}]"
TOKEN_RE = r"[\p{L}\p{M}\p{N}\p{Pc}]+|[^\p{L}\p{M}\p{N}\p{Pc}\s]+"


def sql_quotes(x: str) -> str:
    src = "".join(X.QUOTES)
    dst = "".join(X.QUOTES.values()).replace("'", "''")
    return f"translate({x}, '{src}', '{dst}')"


def sql_dashes(x: str) -> str:
    return f"translate({x}, '{X.DASHES}', '----')"


def sql_blanks(x: str) -> str:
    return rf"regexp_replace({x}, '[ \t]+', ' ', 'g')"


def sql_control(x: str) -> str:
    return f"regexp_replace({x}, '{CTRL_RE}', '', 'g')"


def sql_clean(x: str) -> str:
    return sql_strip(sql_blanks(sql_dashes(sql_quotes(sql_control(f"nfc_normalize(coalesce({x}, ''))")))))


def sql_reason(s: str, t: str) -> str:
    return (
        f"CASE WHEN {s} = '' OR {t} = '' THEN 'empty' "
        f"WHEN starts_with({s}, '#') OR starts_with({t}, '#') THEN 'comment' "
        f"WHEN NOT (length({s}) BETWEEN 3 AND 500 AND length({t}) BETWEEN 3 AND 500) THEN 'length' END"
    )


def sql_sentences(x: str) -> str:
    cut = rf"regexp_replace({sql_strip(x)}, '([.!?]){WS_RE}+', '\1' || chr(10), 'g')"
    return (
        f"list_filter(list_transform(string_split_regex({cut}, '\\n+'), lambda s: {sql_strip('s')}), lambda s: s <> '')"
    )


def sql_english(x: str) -> str:
    once = rf"regexp_replace({x}, '(^|[^\p{{L}}\p{{N}}_])i([^\p{{L}}\p{{N}}_]|$)', '\1I\2', 'g')"
    twice = rf"regexp_replace({once}, '(^|[^\p{{L}}\p{{N}}_])i([^\p{{L}}\p{{N}}_]|$)', '\1I\2', 'g')"
    return f"(upper(substr({twice}, 1, 1)) || substr({twice}, 2))"


def sql_entities(x: str) -> str:
    return rf"regexp_replace({x}, '& ([\p{{L}}\p{{N}}_]+) ;', '&\1;', 'g')"


def sql_basic_unescape(x: str) -> str:
    for entity, char in X.BASIC_ENTITIES.items():
        x = "replace({}, '{}', '{}')".format(x, entity, char.replace("'", "''"))
    return x


def sql_tidy(x: str) -> str:
    """Spaces around punctuation, double blanks, ends."""
    x = rf"regexp_replace({x}, '{WS_RE}+([.,!?;:''\"])', '\1', 'g')"
    x = rf"regexp_replace({x}, '([\[(]){WS_RE}+', '\1', 'g')"
    return sql_strip(f"regexp_replace({x}, ' {{2,}}', ' ', 'g')")


def sql_clean_output(x: str) -> str:
    return sql_tidy(sql_basic_unescape(sql_entities(x)))


_TAG = "'<2' || lang || '>'"

CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "doc_lines": (
        (),
        f"""SELECT doc_id * {LINES_PER_DOC} + pos - 1 AS line_no, doc_id, pos, lang, line FROM (
             SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS line,
                    generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)""",
    ),
    "line_pairs": (
        ("doc_lines",),
        """SELECT x.line_no, x.lang, e.line AS src, x.line AS tgt
           FROM doc_lines e JOIN doc_lines x ON x.doc_id = e.doc_id + 1 AND x.pos = e.pos
           WHERE e.lang = 'en' AND x.lang <> 'en'""",
    ),
    "dirty_pairs": (
        ("line_pairs",),
        """SELECT line_no, lang, tgt, CASE line_no % 8
             WHEN 0 THEN chr(8220) || src || chr(8221) || '  ' || chr(171) || 'x' || chr(187)
             WHEN 1 THEN src || chr(8203) || chr(1)
             WHEN 2 THEN '  ' || src || chr(9) || chr(9) || '  end '
             WHEN 3 THEN 'e' || chr(769) || ' ' || src
             WHEN 4 THEN src || ' ' || chr(8212) || ' ' || chr(8210)
             WHEN 5 THEN '#' || src
             WHEN 6 THEN chr(64300)
             ELSE chr(2392) || chr(2392) END AS src FROM line_pairs""",
    ),
    "dirty_lines": (
        ("doc_lines",),
        """SELECT line_no, lang, CASE line_no % 8
             WHEN 0 THEN chr(8220) || src || chr(8221) || '  ' || chr(171) || 'x' || chr(187)
             WHEN 1 THEN src || chr(8203) || chr(1)
             WHEN 2 THEN '  ' || src || chr(9) || chr(9) || '  end '
             WHEN 3 THEN 'e' || chr(769) || ' ' || src
             WHEN 4 THEN src || ' ' || chr(8212) || ' ' || chr(8210)
             WHEN 5 THEN '#' || src
             WHEN 6 THEN chr(64300)
             ELSE chr(2392) || chr(2392) END AS src FROM (SELECT *, line AS src FROM doc_lines)""",
    ),
    "clean_pairs": (
        ("dirty_pairs",),
        f"SELECT line_no, lang, {sql_clean('src')} AS src, {sql_clean('tgt')} AS tgt FROM dirty_pairs",
    ),
    "judged_pairs": (
        ("clean_pairs",),
        f"SELECT *, {sql_reason('src', 'tgt')} AS reason FROM clean_pairs",
    ),
    "both_ways": (
        ("line_pairs",),
        f"""SELECT line_no, lang, 0 AS direction, {_TAG} || ' ' || replace(src, chr(9), ' ') AS src,
                   replace(tgt, chr(9), ' ') AS tgt FROM line_pairs
            UNION ALL
            SELECT line_no, lang, 1, '<2en> ' || replace(tgt, chr(9), ' '), replace(src, chr(9), ' ') FROM line_pairs""",
    ),
    "tagged_lines": (
        ("both_ways",),
        """SELECT line_no, direction, CASE WHEN line_no % 17 = 0 THEN src || ' ' || tgt
             WHEN line_no % 19 = 0 THEN src || chr(9) || ' '
             WHEN line_no % 23 = 0 THEN ' ' || chr(9) || ' '
             ELSE '  ' || src || chr(9) || tgt END AS value FROM both_ways""",
    ),
    "parsed_lines": (
        ("tagged_lines",),
        f"""SELECT line_no, direction, l,
              {sql_strip("CASE WHEN strpos(l, chr(9)) > 0 THEN left(l, strpos(l, chr(9)) - 1) ELSE l END")} AS src,
              {sql_strip("CASE WHEN strpos(l, chr(9)) > 0 THEN substr(l, strpos(l, chr(9)) + 1) END")} AS tgt
            FROM (SELECT *, {sql_strip('value')} AS l FROM tagged_lines)""",
    ),
    "runs": (
        (),
        """SELECT event_type AS run_id, CAST(day(ts) AS BIGINT) AS epoch,
             CAST(sum(CAST(value AS DECIMAL(18,2))) FILTER (user_id % 2 = 0) AS DOUBLE) / count(*) FILTER (user_id % 2 = 0) AS train,
             CAST(sum(CAST(value AS DECIMAL(18,2))) FILTER (user_id % 2 <> 0) AS DOUBLE) / count(*) FILTER (user_id % 2 <> 0) AS val,
             count(*) AS n_batches
           FROM events GROUP BY 1, 2""",
    ),
    "judged_runs": (
        ("runs",),
        """SELECT *, min(val) OVER (PARTITION BY run_id ORDER BY epoch
                         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_best FROM runs""",
    ),
    "batch_losses": ((), "SELECT event_type AS run_id, event_id AS n, CAST(value AS DECIMAL(18,2)) AS loss FROM events"),
    "token_scores": (
        (),
        """SELECT l_orderkey AS batch_id, l_linenumber AS pos, l_partkey % 5 AS target,
             -ln(1 + l_quantity) AS logprob, -(1 + l_discount) AS mean_logprob FROM lineitem""",
    ),
    "parameters": (
        (),
        "SELECT vec_id % 5 AS ckpt, 'layer' || label AS name, embedding AS values_ FROM embeddings",
    ),
    "hypotheses": (
        ("doc_lines",),
        """SELECT line_no AS id, line AS ref,
             array_to_string(list_filter(string_split(line, ' '), lambda w, i: (i - 1) % 4 <> 3), ' ') AS hyp
           FROM doc_lines WHERE trim(line) <> ''""",
    ),
    "requests": (
        (),
        f"""SELECT conv_id * {TURNS_PER_CONV} + turn AS req_id,
              CASE WHEN conv_id % 10 = 0 THEN ' ' || chr(160) || chr(10) ELSE ' i ' || text || ' i' END AS source_text,
              {_LANG_LIST}[conv_id % 5 + 1] AS source_lang, {_LANG_LIST}[turn % 5 + 1] AS target_lang
            FROM conversations""",
    ),
    "sentence_pairs": (
        ("line_pairs",),
        f"""SELECT lang, s.src AS src, t.tgt AS tgt FROM
              (SELECT line_no, lang, unnest({sql_sentences('src')}) AS src,
                      generate_subscripts({sql_sentences('src')}, 1) AS k FROM line_pairs) s
              JOIN (SELECT line_no, unnest({sql_sentences('tgt')}) AS tgt,
                      generate_subscripts({sql_sentences('tgt')}, 1) AS k FROM line_pairs) t USING (line_no, k)""",
    ),
    "memory": (
        ("sentence_pairs",),
        f"""SELECT 'en' AS src_lang, lang AS tgt_lang, {sql_english('src')} AS src, min(tgt) AS tgt
              FROM sentence_pairs GROUP BY 1, 2, 3
            UNION ALL
            SELECT lang, 'en', tgt, min({sql_english('src')}) FROM sentence_pairs GROUP BY 1, 2, 3""",
    ),
    "tidy_memory": (
        ("memory",),
        f"SELECT src_lang, tgt_lang, src, {sql_clean_output('tgt')} AS tgt FROM memory",
    ),
    "line_requests": (
        ("line_pairs",),
        """SELECT line_no AS req_id, CASE WHEN line_no % 3 = 0 THEN src ELSE tgt END AS source_text,
             CASE WHEN line_no % 3 = 0 THEN 'en' ELSE lang END AS source_lang,
             CASE line_no % 3 WHEN 0 THEN lang WHEN 1 THEN 'en'
               ELSE CASE lang WHEN 'de' THEN 'fr' WHEN 'fr' THEN 'es' ELSE 'de' END END AS target_lang
           FROM line_pairs""",
    ),
    "line_tokens": (
        ("doc_lines",),
        f"SELECT line_no, lang, regexp_extract_all(line, '{TOKEN_RE}') AS tokens FROM doc_lines",
    ),
    "word_freq": (
        ("line_tokens",),
        "SELECT token, count(*) AS n FROM (SELECT unnest(tokens) AS token FROM line_tokens) GROUP BY 1",
    ),
    "vocab": (
        ("word_freq",),
        """SELECT * FROM (VALUES ('[PAD]', 0), ('[UNK]', 1), ('[BOS]', 2), ('[EOS]', 3)) v(token, id)
           UNION ALL
           SELECT token, 3 + row_number() OVER (ORDER BY n DESC, token) FROM
             (SELECT * FROM word_freq ORDER BY n DESC, token LIMIT 1996)""",
    ),
    "line_ids": (
        ("line_tokens", "vocab"),
        """SELECT line_no, lang, list_transform(
               list_filter(list_sort(list({'pos': pos, 'id': coalesce(id, 1)})), lambda x: x.pos IS NOT NULL),
               lambda x: x.id) AS ids
           FROM line_tokens LEFT JOIN (SELECT line_no AS l2, unnest(tokens) AS token,
                  generate_subscripts(tokens, 1) AS pos FROM line_tokens) o ON l2 = line_no
           LEFT JOIN vocab USING (token) GROUP BY 1, 2""",
    ),
    "bigrams": (
        ("line_ids",),
        """SELECT prev, next, n, round(ln(n / sum(n) OVER (PARTITION BY prev)), 6) AS logprob FROM (
             SELECT prev, next, count(*) AS n FROM (
               SELECT unnest(list_concat([2], ids)) AS prev, unnest(list_concat(ids, [3])) AS next FROM line_ids)
             GROUP BY 1, 2)""",
    ),
    "document_bigrams": (
        ("line_ids",),
        """SELECT src_id, prev, next, n, round(ln(n / sum(n) OVER (PARTITION BY src_id, prev)), 6) AS logprob FROM (
             SELECT src_id, prev, next, count(*) AS n FROM (
               SELECT line_no // 4294967296 AS src_id, unnest(list_concat([2], ids)) AS prev, unnest(list_concat(ids, [3])) AS next
               FROM line_ids) GROUP BY 1, 2, 3)""",
    ),
    "page_text": (
        (),
        r"""SELECT page_id, regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '&([a-z]+);', '& \1 ;', 'g') AS text
            FROM pages""",
    ),
}


def with_inputs(body: str, *names: str) -> str:
    """SQL text: the named inputs, with what they need, then ``body``."""
    order: list[str] = []

    def add(name: str) -> None:
        needs, _ = CTES[name]
        for n in needs:
            add(n)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    if not order:
        return body
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({CTES[n][1]})" for n in order) + "\n" + body
