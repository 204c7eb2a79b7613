"""Queries over tokens, vocabularies, id arrays and candidate search."""

from __future__ import annotations

from pyspark.sql import functions as F

from bitexture.functions import arrays as A
from bitexture.functions import scores as M
from bitexture.operators import bpe as B
from bitexture.operators import search as H
from bitexture.operators import tokens as K
from bitexture.plans import inputs as I
from bitexture.plans.registry import query
from bitexture.session import stored

q = I.with_inputs
LENGTH = 16


def _text(c):
    """Arrays are compared as text."""
    return F.array_join((F.col(c) if isinstance(c, str) else c).cast("array<string>"), " ")


@query(q("SELECT line_no, array_to_string(tokens, ' ') AS tokens FROM line_tokens", "line_tokens"))
def pretokenize(spark, sf):
    return I.line_tokens(spark, sf).select("line_no", F.array_join("tokens", " ").alias("tokens"))


@query(q("SELECT token, n FROM word_freq", "word_freq"))
def word_freq(spark, sf):
    return K.word_freq(I.doc_lines(spark, sf), "line")


@query(q("SELECT token, CAST(id AS INTEGER) AS id FROM vocab", "vocab"))
def build_vocab(spark, sf):
    return I.vocab(spark, sf)


@query(
    q(
        """SELECT "left", "right", CAST(sum(n) AS BIGINT) AS n FROM (
             SELECT n, unnest(string_split(token, '')[:-2]) AS "left", unnest(string_split(token, '')[2:]) AS "right"
             FROM word_freq WHERE length(token) > 1) GROUP BY 1, 2""",
        "word_freq",
    )
)
def symbol_pair_counts(spark, sf):
    words = K.word_freq(I.doc_lines(spark, sf), "line")
    return K.symbol_pair_counts(words.select("n", F.split("token", "").alias("symbols")))


@query(q("SELECT line_no, lang, array_to_string(ids, ' ') AS ids FROM line_ids", "line_ids"))
def vocab_lookup(spark, sf):
    return I.line_ids(spark, sf).select("line_no", "lang", _text("ids").alias("ids"))


@query(
    q(
        f"""SELECT line_no, array_to_string(CASE WHEN len(m) < {LENGTH} THEN list_concat(m, list_transform(range({LENGTH} - len(m)), lambda x: 0))
              ELSE list_concat(m[:{LENGTH} - 1], [3]) END, ' ') AS ids FROM (SELECT line_no, list_concat([2], ids, [3]) AS m FROM line_ids)""",
        "line_ids",
    )
)
def pad_or_trim(spark, sf):
    """Begin and end markers, then the fixed training length."""
    ids = A.pad_or_trim(A.add_bos_eos(F.col("ids")), LENGTH)
    return I.line_ids(spark, sf).select("line_no", _text(ids).alias("ids"))


@query(
    q(
        """SELECT line_no, array_to_string(CASE WHEN len(ids) < 64 THEN list_concat(ids, list_transform(range(64 - len(ids)), lambda x: 0))
              ELSE list_concat(ids[:63], [2]) END, ' ') AS ids FROM line_ids""",
        "line_ids",
    )
)
def pad_or_trim_eos2(spark, sf):
    """The other end marker id in use, at the default length."""
    return I.line_ids(spark, sf).select("line_no", _text(A.pad_or_trim(F.col("ids"), 64, eos=2)).alias("ids"))


@query(
    q(
        f"""SELECT line_no, array_to_string(list_concat(ids[:{LENGTH}], list_transform(range(greatest({LENGTH} - len(ids), 0)), lambda x: 0)), ' ') AS ids
            FROM line_ids""",
        "line_ids",
    )
)
def pad_or_slice(spark, sf):
    return I.line_ids(spark, sf).select("line_no", _text(A.pad_or_slice(F.col("ids"), LENGTH)).alias("ids"))


@query(q("SELECT line_no, array_to_string(list_concat([2], ids, [3]), ' ') AS ids FROM line_ids", "line_ids"))
def add_bos_eos(spark, sf):
    return I.line_ids(spark, sf).select("line_no", _text(A.add_bos_eos(F.col("ids"))).alias("ids"))


@query(
    q(
        """SELECT line_no, array_to_string(list_filter(ids, lambda x: x NOT IN (5, 7, 9)), ' ') AS ids FROM line_ids""",
        "line_ids",
    )
)
def drop_special(spark, sf):
    return I.line_ids(spark, sf).select("line_no", _text(A.drop_special(F.col("ids"), (5, 7, 9))).alias("ids"))


@query(
    q(
        """SELECT line_no, array_to_string(list_concat([2], ids), ' ') AS dec_in, array_to_string(list_concat(ids, [3]), ' ') AS label
           FROM line_ids""",
        "line_ids",
    )
)
def teacher_forcing(spark, sf):
    ids = A.add_bos_eos(F.col("ids"))
    return I.line_ids(spark, sf).select(
        "line_no", _text(A.decoder_input(ids)).alias("dec_in"), _text(A.decoder_label(ids)).alias("label")
    )


@query(
    q(
        f"""SELECT line_no, repeat('0', least(len(ids), {LENGTH})) || repeat('1', greatest({LENGTH} - len(ids), 0)) AS mask
            FROM line_ids""",
        "line_ids",
    )
)
def padding_mask(spark, sf):
    mask = A.padding_mask(A.pad_or_slice(F.col("ids"), LENGTH))
    text = F.array_join(F.transform(mask, lambda m: m.cast("int").cast("string")), "")
    return I.line_ids(spark, sf).select("line_no", text.alias("mask"))


@query(
    q(
        """SELECT line_no, coalesce(string_agg(token, ' ' ORDER BY pos), '') AS text FROM line_ids LEFT JOIN (
             SELECT line_no AS l2, pos, token FROM (SELECT line_no, unnest(ids) AS id, generate_subscripts(ids, 1) AS pos FROM line_ids) o
             JOIN vocab USING (id) WHERE id > 3) d ON l2 = line_no GROUP BY 1""",
        "line_ids",
    )
)
def decode_text(spark, sf):
    """Ids back to text without the special tokens."""
    out = K.decode_text(I.line_ids(spark, sf), I.vocab(spark, sf), special_ids=range(4))
    return out.select("line_no", "text")


@query(
    q(
        """SELECT lang, count(*) AS n_rows, round(avg(len(ids)), 6) AS mean_len, max(len(ids)) AS max_len,
             count(*) FILTER (len(ids) > 64) AS n_cut, round(avg(CASE WHEN len(ids) > 64 THEN 1 ELSE 0 END), 6) AS share_cut,
             round(quantile_cont(len(ids), 0.5), 6) AS p50_len, round(quantile_cont(len(ids), 0.95), 6) AS p95_len
           FROM line_ids GROUP BY 1""",
        "line_ids",
    )
)
def token_length_stats(spark, sf):
    s = K.token_length_stats(I.line_ids(spark, sf))
    return s.withColumns({c: F.round(c, 6) for c in ("mean_len", "share_cut", "p50_len", "p95_len")})


@query(q("SELECT prev, next, n, logprob FROM bigrams", "bigrams"))
def bigram_scores(spark, sf):
    return I.bigrams(spark, sf)


@query(
    q(
        """SELECT prev, next, logprob FROM (SELECT *, row_number() OVER (PARTITION BY prev ORDER BY logprob DESC, next) AS r FROM bigrams)
           WHERE r = 1""",
        "bigrams",
    )
)
def greedy_next(spark, sf):
    return H.greedy_next(I.bigrams(spark, sf)).select("prev", "next", "logprob")


_TOP = """best AS MATERIALIZED (SELECT prev, next, logprob FROM (
    SELECT *, row_number() OVER (PARTITION BY prev ORDER BY logprob DESC, next) AS r FROM bigrams) WHERE r <= 5),
  start AS (SELECT doc_id AS src_id, 0.0::DOUBLE AS log_prob, [2, ids[1]] AS tokens FROM (
      SELECT line_no // 4294967296 AS doc_id, arg_min(ids, line_no) AS ids FROM line_ids WHERE len(ids) > 0 GROUP BY 1)),
  expanded AS MATERIALIZED (SELECT src_id, round(log_prob + logprob, 6) AS log_prob, list_append(tokens, next) AS tokens
      FROM start JOIN best ON prev = tokens[-1]),
  scored AS (SELECT *, round(log_prob / pow(len(tokens), 0.7), 6) AS score, tokens[-1] = 3 AS ended FROM expanded),
  pruned AS MATERIALIZED (SELECT src_id, log_prob, tokens, score, CASE WHEN ended THEN 'finished' ELSE 'live' END AS state FROM (
      SELECT *, row_number() OVER (PARTITION BY src_id, ended ORDER BY score DESC, tokens) AS r FROM scored) WHERE ended OR r <= 3)"""


def _with_search(body):
    return q("SELECT @", "bigrams").replace("SELECT @", f", {_TOP} {body}")


def start_beams(ids):
    """One beam per document: begin marker and first token."""
    doc = F.floor(F.col("line_no") / I.LINES_PER_DOC).cast("bigint").alias("src_id")
    first = ids.where(F.size("ids") > 0).groupBy(doc).agg(F.min_by(F.element_at("ids", 1), "line_no").alias("first"))
    return first.select(
        "src_id", F.lit(0.0).alias("log_prob"), F.array(F.lit(A.BOS_ID), F.col("first")).alias("tokens")
    )


def _search_inputs(spark, sf, own=False, one_step=False):
    """Beams and scores from one encoding of the lines; scores of all lines, or
    each document's own, for ``one_step`` those that its beams can take."""
    ids = stored(I.line_ids(spark, sf), "line-ids")
    beams = start_beams(ids)
    if not own:
        return beams, K.bigram_scores(ids)
    return beams, I.document_bigrams_of(ids, beams if one_step else None)


@query(_with_search("SELECT src_id, log_prob, array_to_string(tokens, ' ') AS tokens FROM expanded"))
def beam_expand(spark, sf):
    out = H.beam_expand(*_search_inputs(spark, sf))
    return out.select("src_id", "log_prob", _text("tokens").alias("tokens"))


@query(_with_search("SELECT src_id, score, state, array_to_string(tokens, ' ') AS tokens FROM pruned"))
def beam_prune(spark, sf):
    out = H.beam_prune(H.beam_expand(*_search_inputs(spark, sf)), k=3)
    return out.select("src_id", "score", "state", _text("tokens").alias("tokens"))


@query(
    _with_search(
        """SELECT src_id, score, state, array_to_string(list_filter(tokens, lambda x: x NOT IN (0, 2, 3)), ' ') AS ids FROM (
             SELECT *, row_number() OVER (PARTITION BY src_id ORDER BY state = 'finished' DESC, score DESC, tokens) AS r FROM pruned)
           WHERE r = 1"""
    )
)
def nbest_select(spark, sf):
    beams = H.beam_prune(H.beam_expand(*_search_inputs(spark, sf)), k=3)
    return H.nbest_select(beams).select("src_id", "score", "state", _text("ids").alias("ids"))


@query(
    q(
        """SELECT DISTINCT line_no // 4294967296 AS src_id, array_to_string(list_concat([2], ids, [3]), ' ') AS tokens
           FROM line_ids""",
        "line_ids",
    )
)
def distinct_hypotheses(spark, sf):
    """A document's lines as finished hypotheses: repeated ones once."""
    doc = F.floor(F.col("line_no") / I.LINES_PER_DOC).cast("bigint").alias("src_id")
    done = I.line_ids(spark, sf).select(doc, A.add_bos_eos(F.col("ids")).alias("tokens"))
    return H.distinct_hypotheses(done).select("src_id", _text("tokens").alias("tokens"))


@query(
    q(
        """SELECT line_no, round(log_prob / pow(n, 0.7), 6) AS score FROM (
             SELECT line_no, len(ids) AS n, -ln(1 + len(ids)) AS log_prob FROM line_ids WHERE len(ids) > 0)""",
        "line_ids",
    )
)
def length_penalized(spark, sf):
    ids = I.line_ids(spark, sf).where(F.size("ids") > 0)
    score = M.length_penalized(-F.log(1 + F.size("ids")), F.size("ids"))
    return ids.select("line_no", F.round(score, 6).alias("score"))


_STEPS, _BEAM = 5, 5


def _sql_decode(table: str = "bigrams", keys: str = "prev", steps: int = _STEPS) -> str:
    """The search written out, one block of tables per output position."""
    on = "prev = tokens[-1]" + (" AND b.src_id = l.src_id" if "src_id" in keys else "")
    parts = [
        f"""best AS MATERIALIZED (SELECT {keys}, next, logprob FROM (
             SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY logprob DESC, next) AS r FROM {table}) WHERE r <= 5)""",
        """live0 AS MATERIALIZED (SELECT doc_id AS src_id, 0.0::DOUBLE AS log_prob, [2, ids[1]] AS tokens, 0.0::DOUBLE AS score FROM (
             SELECT line_no // 4294967296 AS doc_id, arg_min(ids, line_no) AS ids FROM line_ids WHERE len(ids) > 0 GROUP BY 1))""",
    ]
    for i in range(1, steps + 1):
        parts.append(
            f"""step{i} AS MATERIALIZED (SELECT *, round(log_prob / pow(len(tokens), 0.7), 6) AS score, tokens[-1] = 3 AS ended FROM (
                  SELECT l.src_id, round(log_prob + logprob, 6) AS log_prob, list_append(tokens, next) AS tokens
                  FROM live{i - 1} l JOIN best b ON {on}))"""
        )
        parts.append(
            f"""live{i} AS MATERIALIZED (SELECT src_id, log_prob, tokens, score FROM (
                  SELECT *, row_number() OVER (PARTITION BY src_id ORDER BY score DESC, tokens) AS r FROM step{i} WHERE NOT ended)
                WHERE r <= {_BEAM})"""
        )
    pool = " UNION ALL ".join(
        [f"SELECT src_id, tokens, score, 'finished' AS state FROM step{i} WHERE ended" for i in range(1, steps + 1)]
        + [f"SELECT src_id, tokens, score, 'live' FROM live{steps}"]
    )
    body = f"""SELECT src_id, score, state, array_to_string(list_filter(tokens, lambda x: x NOT IN (0, 2, 3)), ' ') AS ids FROM (
        SELECT *, row_number() OVER (PARTITION BY src_id ORDER BY state, score DESC, tokens) AS r FROM ({pool})) WHERE r = 1"""
    return q("SELECT @", table).replace("SELECT @", ", " + ",\n".join(parts) + "\n" + body)


@query(_sql_decode())
def decode_corpus(spark, sf):
    """Beam search from every document's first token (five positions)."""
    out = H.decode_corpus(*_search_inputs(spark, sf), k=_BEAM, max_len=_STEPS)
    return out.select("src_id", "score", "state", _text("ids").alias("ids"))


_EXPANDED_EACH = """, best AS (SELECT src_id, prev, next, logprob FROM (
    SELECT *, row_number() OVER (PARTITION BY src_id, prev ORDER BY logprob DESC, next) AS r FROM document_bigrams) WHERE r <= 5),
  start AS (SELECT line_no // 4294967296 AS src_id, [2, arg_min(ids, line_no)[1]] AS tokens FROM line_ids WHERE len(ids) > 0 GROUP BY 1)
  SELECT s.src_id, logprob AS log_prob, array_to_string(list_append(tokens, next), ' ') AS tokens
  FROM start s JOIN best b ON b.src_id = s.src_id AND prev = tokens[-1]"""


@query(q("SELECT @", "document_bigrams").replace("SELECT @", _EXPANDED_EACH))
def beam_expand_each(spark, sf):
    """One step of every document by its own bigrams."""
    out = H.beam_expand(*_search_inputs(spark, sf, own=True, one_step=True))
    return out.select("src_id", "log_prob", _text("tokens").alias("tokens"))


@query(_sql_decode("document_bigrams", "src_id, prev", A.MAX_LEN))
def decode_each(spark, sf):
    """Beam search from every document's first token by the document's own
    bigrams, at the default number of positions."""
    out = H.decode_corpus(*_search_inputs(spark, sf, own=True), k=_BEAM)
    return out.select("src_id", "score", "state", _text("ids").alias("ids"))


def _model(spark, sf):
    """A vocabulary of the default size."""
    return B.train_bpe(I.doc_lines(spark, sf), "line")


@query()
def train_bpe(spark, sf):
    """Merges of the vocabulary of all lines."""
    return _model(spark, sf).merges


@query()
def bpe_encode(spark, sf):
    """All lines encoded with a vocabulary trained on them, and decoded."""
    model = _model(spark, sf)
    ids = B.bpe_encode(I.doc_lines(spark, sf).select("line_no", "line"), model, "line").drop("line")
    out = B.bpe_decode(ids.withColumn("id_text", _text("ids")), model)
    return out.select("line_no", F.col("id_text").alias("ids"), "text")


@query()
def encode_dataset(spark, sf):
    """Tagged pairs as fixed-length id arrays."""
    pairs = I.line_pairs(spark, sf).select("line_no", "src", "tgt")
    out = B.encode_dataset(pairs, _model(spark, sf))
    return out.select("line_no", _text("src_ids").alias("src_ids"), _text("tgt_ids").alias("tgt_ids"))


_MERGES = 12


def _sql_merges() -> str:
    """Training written out: the top pair, then every word with it merged."""
    parts = [
        """words0 AS MATERIALIZED (SELECT n, array_to_string(list_transform(string_split(token, ''),
             lambda c: '<' || unicode(c) || '>'), '') AS word FROM word_freq)""",
        """chars AS (SELECT DISTINCT unicode(c) AS code, c AS text FROM (SELECT unnest(string_split(token, '')) AS c FROM word_freq))""",
    ]
    known = ["SELECT code, text FROM chars"]
    for i in range(_MERGES):
        parts.append(
            f"""pairs{i} AS (SELECT l, r, sum(n) AS n FROM (SELECT n, unnest(c[:-2]) AS l, unnest(c[2:]) AS r FROM (
                  SELECT n, list_transform(string_split(word[2:-2], '><'), lambda x: CAST(x AS INTEGER)) AS c FROM words{i}))
                GROUP BY 1, 2 HAVING sum(n) >= 2)"""
        )
        parts.append(
            f"""top{i} AS MATERIALIZED (SELECT {i} AS rank, t.l, t.r, a.text AS "left", b.text AS "right", a.text || b.text AS merged,
                  {1114112 + i} AS code FROM (SELECT * FROM pairs{i} ORDER BY n DESC, l, r LIMIT 1) t
                JOIN ({' UNION ALL '.join(known)}) a ON a.code = t.l JOIN ({' UNION ALL '.join(known)}) b ON b.code = t.r)"""
        )
        parts.append(
            f"""words{i + 1} AS MATERIALIZED (SELECT n, replace(word, '<' || l || '><' || r || '>', '<' || code || '>') AS word
                FROM words{i}, top{i})"""
        )
        known.append(f"SELECT code, merged FROM top{i}")
    body = " UNION ALL ".join(
        f"""SELECT CAST(rank AS INTEGER) AS rank, "left", "right", merged FROM top{i}""" for i in range(_MERGES)
    )
    return q("SELECT @", "word_freq").replace("SELECT @", ", " + ",\n".join(parts) + "\n" + body)


@query(_sql_merges())
def train_bpe_merges(spark, sf):
    """The first merges over all lines: room for the characters and these."""
    words = stored(K.word_freq(I.doc_lines(spark, sf), "line"), "word-counts")
    chars = words.select(F.explode(F.split("token", "")).alias("c")).distinct().count()
    size = len(K.SPECIAL_TOKENS) + chars + _MERGES
    return B.train_on_words(words, vocab_size=size).merges


# A small model given in advance: letters, two marks and some merges.
_GIVEN_CHARS = "abcdefghijklmnopqrstuvwxyz.,"
_GIVEN_MERGES = [
    ("e", "n"), ("t", "h"), ("i", "n"), ("a", "n"), ("e", "r"), ("o", "n"), ("th", "e"), ("in", "g"),
    ("an", "d"), ("e", "s"), ("en", "t"), ("i", "on"), ("t", "ion"), ("er", "e"), ("l", "e"), ("d", "e"),
]


def _given_vocab():
    tokens = [*K.SPECIAL_TOKENS, *_GIVEN_CHARS, *[a + b for a, b in _GIVEN_MERGES]]
    return [(t, i) for i, t in enumerate(tokens)]


def _given_model(spark):
    merges = [(i, a, b, a + b) for i, (a, b) in enumerate(_GIVEN_MERGES)]
    return B.BpeModel(
        spark.createDataFrame(_given_vocab(), "token string, id int"),
        spark.createDataFrame(merges, "rank int, left string, right string, merged string"),
        K.SPECIAL_TOKENS,
    )


def _sql_word_ids(tokens: str) -> str:
    """Tables that encode every distinct token of ``tokens (token)``."""
    word = "array_to_string(list_transform(string_split(token, ''), lambda c: '<' || c || chr(1)), '')"
    for a, b in _GIVEN_MERGES:
        word = f"replace({word}, '<{a}' || chr(1) || '<{b}' || chr(1), '<{a + b}' || chr(1))"
    values = ", ".join("('{}', {})".format(t, i) for t, i in _given_vocab())
    return f"""given(symbol, id) AS MATERIALIZED (SELECT * FROM (VALUES {values}) v(symbol, id)),
      parts AS (SELECT token, unnest(s) AS symbol, generate_subscripts(s, 1) AS k FROM (
        SELECT token, list_transform(string_split({word}, chr(1))[:-2], lambda x: x[2:]) AS s FROM (SELECT DISTINCT token FROM {tokens}))),
      word_ids AS MATERIALIZED (SELECT token, list(coalesce(id, 1) ORDER BY k) AS ids FROM parts LEFT JOIN given USING (symbol) GROUP BY 1)"""


@query(
    q("SELECT @", "word_freq", "line_tokens").replace(
        "SELECT @",
        f""", {_sql_word_ids('word_freq')},
        opened AS (SELECT line_no, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS pos FROM line_tokens),
        encoded AS (SELECT line_no, flatten(list(ids ORDER BY pos)) AS ids FROM opened JOIN word_ids USING (token) GROUP BY 1)
        SELECT line_no, array_to_string(list_concat([2], coalesce(ids, []), [3]), ' ') AS ids
        FROM line_tokens LEFT JOIN encoded USING (line_no)""",
    )
)
def bpe_encode_given(spark, sf):
    """All lines encoded with a given model."""
    lines = I.doc_lines(spark, sf).select("line_no", "line")
    return B.bpe_encode(lines, _given_model(spark), "line").select("line_no", _text("ids").alias("ids"))


@query(
    q("SELECT @", "line_pairs").replace(
        "SELECT @",
        f""", sides AS (SELECT line_no, 'src' AS side, src AS t FROM line_pairs UNION ALL SELECT line_no, 'tgt', tgt FROM line_pairs),
        opened AS (SELECT line_no, side, unnest(w) AS token, generate_subscripts(w, 1) AS pos FROM (
          SELECT line_no, side, regexp_extract_all(t, '{I.TOKEN_RE}') AS w FROM sides)),
        {_sql_word_ids('opened')},
        encoded AS (SELECT line_no, side, flatten(list(ids ORDER BY pos)) AS ids FROM opened JOIN word_ids USING (token) GROUP BY 1, 2),
        marked AS (SELECT line_no, side, list_concat([2], coalesce(ids, []), [3]) AS m FROM sides LEFT JOIN encoded USING (line_no, side)),
        fixed AS (SELECT line_no, side, array_to_string(CASE WHEN len(m) < 64 THEN list_concat(m, list_transform(range(64 - len(m)), lambda x: 0))
            ELSE list_concat(m[:63], [3]) END, ' ') AS ids FROM marked)
        SELECT a.line_no, a.ids AS src_ids, b.ids AS tgt_ids FROM fixed a JOIN fixed b USING (line_no)
        WHERE a.side = 'src' AND b.side = 'tgt'""",
    )
)
def encode_dataset_given(spark, sf):
    """Pairs as fixed-length id arrays of a given model."""
    pairs = I.line_pairs(spark, sf).select("line_no", "src", "tgt")
    out = B.encode_dataset(pairs, _given_model(spark))
    return out.select("line_no", _text("src_ids").alias("src_ids"), _text("tgt_ids").alias("tgt_ids"))


@query(
    q("SELECT @", "word_freq", "line_tokens").replace(
        "SELECT @",
        f""", {_sql_word_ids('word_freq')}, opened AS (SELECT line_no, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS pos FROM line_tokens),
        encoded AS (SELECT line_no, flatten(list(ids ORDER BY pos)) AS ids FROM opened JOIN word_ids USING (token) GROUP BY 1),
        named AS (SELECT line_no, string_agg(symbol, ' ' ORDER BY k) AS text FROM (
          SELECT line_no, unnest(ids) AS id, generate_subscripts(ids, 1) AS k FROM encoded) JOIN given USING (id)
          WHERE id >= {len(K.SPECIAL_TOKENS)} GROUP BY 1)
        SELECT line_no, coalesce(text, '') AS text FROM line_tokens LEFT JOIN named USING (line_no)""",
    )
)
def tokenizer_round_trip(spark, sf):
    """All lines encoded and decoded by a tokenizer with a given model."""
    tokenizer = B.Tokenizer(_given_model(spark))
    lines = I.doc_lines(spark, sf).select("line_no", "line")
    return tokenizer.decode(tokenizer.encode(lines, "line")).select("line_no", "text")
