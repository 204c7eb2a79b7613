"""Column functions against plain Python."""

import html
import re
import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bitexture.functions import arrays as A
from bitexture.functions import predicates as P
from bitexture.functions import scores as M
from bitexture.functions import text as X
from bitexture.operators import corpus as C

# raw text: cleaned, tidied output, sentences, English with a capital
EXPECTED = [
    (
        '',
        '',
        '',
        [],
        '',
    ),
    (
        '   ',
        '',
        '',
        [],
        '   ',
    ),
    (
        'plain',
        'plain',
        'plain',
        ['plain'],
        'Plain',
    ),
    (
        'e\u0301 composed',
        '\xe9 composed',
        'e\u0301 composed',
        ['e\u0301 composed'],
        'E\u0301 composed',
    ),
    (
        '\u1112\u1161\u11ab Hangul',
        '\ud55c Hangul',
        '\u1112\u1161\u11ab Hangul',
        ['\u1112\u1161\u11ab Hangul'],
        '\u1112\u1161\u11ab Hangul',
    ),
    (
        '\u304b\u3099 kana',
        '\u304c kana',
        '\u304b\u3099 kana',
        ['\u304b\u3099 kana'],
        '\u304b\u3099 kana',
    ),
    (
        '\u212b \u2126 singletons',
        '\xc5 \u03a9 singletons',
        '\u212b \u2126 singletons',
        ['\u212b \u2126 singletons'],
        '\u212b \u2126 singletons',
    ),
    (
        'a\u0323\u0307 order a\u0307\u0323',
        '\u1ea1\u0307 order \u1ea1\u0307',
        'a\u0323\u0307 order a\u0307\u0323',
        ['a\u0323\u0307 order a\u0307\u0323'],
        'A\u0323\u0307 order a\u0307\u0323',
    ),
    (
        '\u201cq\u201d \u2018s\u2019 \xabg\xbb',
        '"q" \'s\' "g"',
        '\u201cq\u201d \u2018s\u2019 \xabg\xbb',
        ['\u201cq\u201d \u2018s\u2019 \xabg\xbb'],
        '\u201cq\u201d \u2018s\u2019 \xabg\xbb',
    ),
    (
        'dash \u2012\u2013\u2014\u2015 end',
        'dash ---- end',
        'dash \u2012\u2013\u2014\u2015 end',
        ['dash \u2012\u2013\u2014\u2015 end'],
        'Dash \u2012\u2013\u2014\u2015 end',
    ),
    (
        'tab\there\t\tand  blanks   .',
        'tab here and blanks .',
        'tab\there\t\tand blanks.',
        ['tab\there\t\tand  blanks   .'],
        'Tab\there\t\tand  blanks   .',
    ),
    (
        'zero\u200bwidth \ufeff bom \xad soft',
        'zerowidth bom soft',
        'zero\u200bwidth \ufeff bom \xad soft',
        ['zero\u200bwidth \ufeff bom \xad soft'],
        'Zero\u200bwidth \ufeff bom \xad soft',
    ),
    (
        'ctrl\x01\x7f\x85\x9f x',
        'ctrl x',
        'ctrl\x01\x7f\x85\x9f x',
        ['ctrl\x01\x7f\x85\x9f x'],
        'Ctrl\x01\x7f\x85\x9f x',
    ),
    (
        'line\nfeed\r\nreturn',
        'line\nfeed\nreturn',
        'line\nfeed\r\nreturn',
        ['line', 'feed', 'return'],
        'Line\nfeed\r\nreturn',
    ),
    (
        '\u3000ideographic space\xa0\u2009',
        'ideographic space',
        'ideographic space',
        ['ideographic space'],
        '\u3000ideographic space\xa0\u2009',
    ),
    (
        '\x1cfile sep\x1f',
        'file sep',
        'file sep',
        ['file sep'],
        '\x1cfile sep\x1f',
    ),
    (
        '\U0001f600 emoji \U000e0041 tag',
        '\U0001f600 emoji tag',
        '\U0001f600 emoji \U000e0041 tag',
        ['\U0001f600 emoji \U000e0041 tag'],
        '\U0001f600 emoji \U000e0041 tag',
    ),
    (
        'Xin ch\xe0o, b\u1ea1n c\xf3 kh\u1ecfe kh\xf4ng?',
        'Xin ch\xe0o, b\u1ea1n c\xf3 kh\u1ecfe kh\xf4ng?',
        'Xin ch\xe0o, b\u1ea1n c\xf3 kh\u1ecfe kh\xf4ng?',
        ['Xin ch\xe0o, b\u1ea1n c\xf3 kh\u1ecfe kh\xf4ng?'],
        'Xin ch\xe0o, b\u1ea1n c\xf3 kh\u1ecfe kh\xf4ng?',
    ),
    (
        '\u4eca\u65e5\u306f\u826f\u3044\u5929\u6c17\u3067\u3059\u306d\u3002',
        '\u4eca\u65e5\u306f\u826f\u3044\u5929\u6c17\u3067\u3059\u306d\u3002',
        '\u4eca\u65e5\u306f\u826f\u3044\u5929\u6c17\u3067\u3059\u306d\u3002',
        ['\u4eca\u65e5\u306f\u826f\u3044\u5929\u6c17\u3067\u3059\u306d\u3002'],
        '\u4eca\u65e5\u306f\u826f\u3044\u5929\u6c17\u3067\u3059\u306d\u3002',
    ),
    (
        '&amp;copy; &lt;b&gt; &nbsp;&notin; &#39;&#x41; &amp &bogus;',
        '&amp;copy; &lt;b&gt; &nbsp;&notin; &#39;&#x41; &amp &bogus;',
        "&copy; <b> \xa0\u2209'A & &bogus;",
        ['&amp;copy; &lt;b&gt; &nbsp;&notin; &#39;&#x41; &amp &bogus;'],
        '&amp;copy; &lt;b&gt; &nbsp;&notin; &#39;&#x41; &amp &bogus;',
    ),
    (
        '& apos ; s & quot ; \xe9 & eacute ;',
        '& apos ; s & quot ; \xe9 & eacute ;',
        '\' s" \xe9 \xe9',
        ['& apos ; s & quot ; \xe9 & eacute ;'],
        '& apos ; s & quot ; \xe9 & eacute ;',
    ),
    (
        "Hello , world ! [ a ] ( b ) ' c '' d : e ; f ?",
        "Hello , world ! [ a ] ( b ) ' c '' d : e ; f ?",
        "Hello, world! [a ] (b )' c'' d: e; f?",
        ['Hello , world !', "[ a ] ( b ) ' c '' d : e ; f ?"],
        "Hello , world ! [ a ] ( b ) ' c '' d : e ; f ?",
    ),
    (
        'One. Two!  Three?\nFour\n\n  Five.Six',
        'One. Two! Three?\nFour\n\n Five.Six',
        'One. Two! Three?\nFour\n\n Five.Six',
        ['One.', 'Two!', 'Three?', 'Four', 'Five.Six'],
        'One. Two!  Three?\nFour\n\n  Five.Six',
    ),
    (
        'i am i, and i.i _i i\u0301 hi',
        'i am i, and i.i _i \xed hi',
        'i am i, and i.i _i i\u0301 hi',
        ['i am i, and i.i _i i\u0301 hi'],
        'I am I, and I.I _i I\u0301 hi',
    ),
    (
        '\xdfstart',
        '\xdfstart',
        '\xdfstart',
        ['\xdfstart'],
        'SSstart',
    ),
]
HOSTILE = [row[0] for row in EXPECTED]


def apply(spark, values, *columns):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    rows = df.select("i", *[c.alias(f"c{k}") for k, c in enumerate(columns)]).orderBy("i").collect()
    return [tuple(r)[1:] for r in rows]


def test_text_functions(spark):
    t = F.col("t")
    got = apply(
        spark,
        HOSTILE,
        X.nfc(t),
        X.preprocess_text(t),
        X.strip_unicode(t),
        X.clean_output(t),
        X.split_sentences(t),
        X.normalize_english(t, F.lit("en")),
        X.html_unescape(t),
    )
    for (value, cleaned, tidied, sentences, english), row in zip(EXPECTED, got):
        assert row[0] == unicodedata.normalize("NFC", value)
        assert row[1] == cleaned, ascii(value)
        assert row[2] == value.strip()
        assert row[3] == tidied, ascii(value)
        assert row[4] == sentences
        assert row[5] == english, ascii(value)
        assert row[6] == html.unescape(value)


def test_null_text(spark):
    t = F.col("t")
    assert apply(spark, [None], X.preprocess_text(t), X.placeholder_if_empty(t)) == [("", X.NO_TRANSLATION)]


def test_fixed_character_sets():
    points = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    assert set(X.WHITESPACE) == {c for c in points if c.isspace()}

    def cls(body):
        return re.compile("[" + re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: "\\U%08x" % int(m.group(1), 16), body) + "]")

    control = cls(X.CONTROL)
    assert all(
        bool(control.match(c)) == (unicodedata.category(c) in ("Cc", "Cf") and c not in "\t\n") for c in points
    )
    seconds = set()
    for c in points:
        parts = unicodedata.decomposition(c).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            seconds.add(chr(int(parts[1], 16)))
    stable = cls(X.NFC_STABLE)
    for c in points:
        if stable.match(c):
            assert unicodedata.normalize("NFC", c) == c and not unicodedata.combining(c) and c not in seconds


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(max_size=30), min_size=40, max_size=60))
def test_cleaned_text_is_clean(spark, values):
    values = [v.encode("utf-8", "ignore").decode() for v in values]
    t = F.col("t")
    once = [r[0] for r in apply(spark, values, X.preprocess_text(t))]
    assert [r[0] for r in apply(spark, once, X.preprocess_text(t))] == once
    for c in once:
        assert c == c.strip() and "  " not in c and "\t" not in c
        assert not any(unicodedata.category(x) in ("Cc", "Cf") and x != "\n" for x in c)
        assert not set(c) & set("\u201c\u201d\u2018\u2019\u2012\u2013\u2014\u2015")
        assert unicodedata.is_normalized("NFC", c)


def test_tags_and_names(spark):
    t = F.col("t")
    tag = X.tag_source(F.lit("hello"), t, default="<2vi>")
    assert apply(spark, ["ja", "xx"], tag) == [("<2ja> hello",), ("<2vi> hello",)]
    names = ["/a/transformer_ep07.pt", "transformer_ep12.pt", "best.pt", "transformer_epX.pt"]
    assert apply(spark, names, X.epoch_from_name(t)) == [(7,), (12,), (0,), (0,)]


def test_unknown_tag_fails(spark):
    import pytest

    with pytest.raises(Exception, match="unknown language: xx"):
        apply(spark, ["xx"], X.tag_source(F.lit("hello"), F.col("t")))


def test_pair_rules(spark):
    pairs = [("abc", "def"), ("", "abc"), ("ab", "abc"), ("#abc", "abc"), ("abc", "#bc"), ("a" * 500, "abc"), ("a" * 501, "abc"),
             (None, "abc"), ("abc", "\U0001f600\U0001f600"), ("abc", "\U0001f600" * 3), ("a\nb", "a\n#")]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, s string, t string")
    s, t = F.col("s"), F.col("t")
    rows = df.select("i", P.is_valid_pair(s, t), P.invalid_reason(s, t), P.maybe_valid_pair(s, t)).orderBy("i").collect()

    def reason(a, b):
        if not a or not b:
            return "empty"
        if a.startswith("#") or b.startswith("#"):
            return "comment"
        return None if 3 <= len(a) <= 500 and 3 <= len(b) <= 500 else "length"

    assert [r[2] for r in rows] == [reason(*p) for p in pairs]
    assert [r[1] for r in rows] == [reason(*p) is None for p in pairs]
    assert all(r[3] or not r[1] for r in rows)
    # composition can lengthen a text
    grown = spark.createDataFrame([("\ufb2c", "abc"), ("abc", "\u0958\u0958"), ("", "abc"), ("#", "abc")], "src string, tgt string")
    assert C.valid_pairs(grown.withColumn("lang", F.lit("x"))).count() == 2


def test_request_rules_in_order(spark):
    names = list(P.REQUEST_LANGUAGES)
    cases = [(" ", "??", "??"), ("x", "??", "??"), ("x", names[0], "??"), ("x", names[0], names[0]), ("x", names[0], names[1])]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, t string, a string, b string")
    status, detail = P.validate_request(F.col("t"), F.col("a"), F.col("b"))
    rows = df.select("i", status.alias("s"), detail.alias("d")).orderBy("i").collect()
    assert [r.s for r in rows] == [400, 400, 400, 400, 200]
    assert rows[0].d == P.EMPTY_TEXT and rows[1].d.startswith(P.BAD_SOURCE) and rows[2].d.startswith(P.BAD_TARGET)
    assert rows[3].d == P.SAME_LANGUAGE and rows[4].d is None


def ids_of(spark, ids, column):
    return spark.createDataFrame([(ids,)], "ids array<int>").select(column).head()[0]


def test_id_arrays(spark):
    ids = F.col("ids")
    assert ids_of(spark, [2, 15, 37, 3], A.pad_or_trim(ids, 6)) == [2, 15, 37, 3, 0, 0]
    long = [2, 15, 37, 99, 102, 55, 201, 3]
    assert ids_of(spark, long, A.pad_or_trim(ids, 6, eos=2)) == [2, 15, 37, 99, 102, 2]
    assert ids_of(spark, long, A.pad_or_trim(ids, 6)) == [2, 15, 37, 99, 102, 3]
    assert ids_of(spark, long, A.pad_or_trim(ids, 8, eos=9)) == long[:7] + [9]
    assert ids_of(spark, long, A.pad_or_slice(ids, 6)) == long[:6]
    assert ids_of(spark, [], A.pad_or_slice(ids, 2)) == [0, 0]
    assert ids_of(spark, [5, 2, 5, 3, 0], A.drop_special(ids)) == [5, 5]
    assert ids_of(spark, long, A.decoder_input(ids)) == long[:-1]
    assert ids_of(spark, long, A.decoder_label(ids)) == long[1:]
    assert ids_of(spark, [], A.decoder_label(ids)) == []
    assert ids_of(spark, [7, 0], A.padding_mask(ids)) == [False, True]


def test_scores(spark):
    import math

    row = spark.range(1, 2).select(
        M.noam_lr(F.lit(10), 256, 3985),
        M.noam_lr(F.lit(3985), 256, 3985),
        M.perplexity(F.lit(4.25)),
        M.length_penalized(F.lit(-3.0), F.lit(5)),
        M.smoothed_nll(F.lit(-1.0), F.lit(-4.0), 0.1),
        M.brevity_penalty(F.lit(8), F.lit(10)),
    ).head()
    assert row[0] == 1e-4
    assert math.isclose(row[1], 256**-0.5 * 3985**-0.5)
    assert math.isclose(row[2], math.exp(4.25))
    assert math.isclose(row[3], -3 / 5**0.7)
    assert math.isclose(row[4], 0.9 + 0.4)
    assert math.isclose(row[5], math.exp(1 - 10 / 8))


def test_unescape_sends_references_only(spark):
    """The same text as the library's, though Python gets no other text."""
    import html
    import random

    rng = random.Random(8)
    bits = ["&", "&amp;", "&amp", "&notit;", "&not", "&#65;", "&#x1F600", "&#x110000;", "&#0;", "&#128;", "&;", "&&lt;", "x", " ", "\n", "&#", "&#x;",
            "&copy", "&CounterClockwiseContourIntegral;", "&" + "q" * 40 + ";", "\u00e9", "\U0001f600", "&\U0001f600;", "&#1;", "&\u00a0;", "&\r;", "&#\u0661;"]
    texts = [None, "", "&", "plain", *bits, *["".join(rng.choices(bits, k=rng.randint(1, 9))) for _ in range(400)]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string").repartition(3)
    found = df.select("id", X.html_unescape(F.col("t")).alias("u"))
    assert {r.id: r.u for r in found.collect()} == {i: None if t is None else html.unescape(t) for i, t in enumerate(texts)}
    assert "regexp_extract_all" in found._jdf.queryExecution().executedPlan().toString().split("ArrowEvalPython")[-1]
