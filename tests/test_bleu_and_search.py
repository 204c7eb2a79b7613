"""BLEU and candidate search against plain Python."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from bitexture.operators import bleu as B
from bitexture.operators import search as H
from bitexture.plans.jobs import evaluate


def counts(h, r):
    m, t = [], []
    for n in range(1, 5):
        a = Counter(tuple(h[i : i + n]) for i in range(len(h) - n + 1))
        b = Counter(tuple(r[i : i + n]) for i in range(len(r) - n + 1))
        m.append(sum(min(c, b[g]) for g, c in a.items()))
        t.append(max(len(h) - n + 1, 0))
    return m, t


def score(m, t, h, r, effective):
    if not any(m):
        return 0.0
    logs, smooth, orders = 0.0, 1.0, 4
    for n in range(4):
        if t[n] == 0:
            if not effective:
                return 0.0
            orders = n
            break
        if m[n] == 0:
            smooth *= 2
            logs += math.log(1 / (smooth * t[n]))
        else:
            logs += math.log(m[n] / t[n])
    bp = 1.0 if h >= r else math.exp(1 - r / h)
    return 100 * bp * math.exp(logs / orders)


def sentences():
    rng = random.Random(4)
    words = ["a", "b", "c", "d", "e"]
    rows = []
    for i in range(150):
        ref = [rng.choice(words) for _ in range(rng.randint(1, 12))]
        hyp = [w for w in ref if rng.random() < 0.8] + ([rng.choice(words)] if rng.random() < 0.5 else [])
        rows.append((i, " ".join(hyp), " ".join(ref)))
    return rows + [(900, "", "a b"), (901, "x y z w", "a b c d"), (902, "a b c d", "a b c d"), (903, "a", "a")]


def test_bleu(spark):
    rows = sentences()
    df = spark.createDataFrame(rows, "id int, hyp string, ref string").repartition(4)
    got = {r.id: r.score for r in B.sentence_bleu(df, "none").collect()}
    total_m, total_t, h_len, r_len = [0] * 4, [0] * 4, 0, 0
    for i, hyp, ref in rows:
        h, r = hyp.split(), ref.split()
        m, t = counts(h, r)
        assert math.isclose(got[i], score(m, t, len(h), len(r), True), abs_tol=1e-9), i
        total_m, total_t = [a + b for a, b in zip(total_m, m)], [a + b for a, b in zip(total_t, t)]
        h_len, r_len = h_len + len(h), r_len + len(r)
    row = B.corpus_bleu(df, "none").head()
    assert [row[f"m{n}"] for n in range(1, 5)] == total_m and [row[f"t{n}"] for n in range(1, 5)] == total_t
    assert math.isclose(row.bleu, score(total_m, total_t, h_len, r_len, False))


def test_perfect_and_hopeless(spark):
    same = spark.createDataFrame([(1, "a b c d e", "a b c d e")], "id int, hyp string, ref string")
    assert math.isclose(B.corpus_bleu(same).head().bleu, 100.0)
    none = spark.createDataFrame([(1, "x", "a b c d e")], "id int, hyp string, ref string")
    assert B.corpus_bleu(none).head().bleu == 0.0


@pytest.mark.parametrize(
    "tokenizer,text,want",
    [
        ("none", " a  b,c ", ["a", "b,c"]),
        ("char", "a b　今日", ["a", "b", "今", "日"]),
        ("13a", "Hello, world! It's 3.5 (or 1,000) end.", ["Hello", ",", "world", "!", "It's", "3.5", "(", "or", "1,000", ")", "end", "."]),
        ("13a", "a &lt;b&gt; &quot;c&quot; 5-6 x-y <skipped>z", ["a", "<", "b", ">", '"', "c", '"', "5", "-", "6", "x-y", "z"]),
    ],
)
def test_bleu_tokens(spark, tokenizer, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(B.bleu_tokens(F.col("t"), tokenizer)).head()[0] == want


def test_best_and_worst_are_stable(spark):
    df = spark.createDataFrame([(i, float(i % 4)) for i in range(40)], "id int, score double").repartition(5)
    assert [r.id for r in B.best_sentences(df).collect()] == [3, 7, 11, 15, 19]
    assert [r.id for r in B.worst_sentences(df).collect()] == [0, 4, 8, 12, 16]


def test_evaluate(spark):
    df = spark.createDataFrame([(1, "A B C D", "a b c d"), (2, "Q", "z")], "id int, src string, tgt string")
    out = evaluate(df, lambda: str.lower, "none", k=1)
    assert {r.id: r.hyp for r in out.hypotheses.collect()} == {1: "a b c d", 2: "q"}
    assert out.best.head().id == 1 and out.worst.head().id == 2
    assert math.isclose(out.best.head().score, 100.0)


def test_bleu_counts_few_texts_at_a_time(spark, monkeypatch):
    """The same counts for any share of text held at a time, also for rows
    that are longer, empty or NULL."""
    from bitexture.operators import bleu as B

    rng = random.Random(3)
    rows = [(i, *(" ".join(rng.choices("abcd", k=rng.choice([0, 1, 5, 60]))) for _ in range(2))) for i in range(60)]
    df = spark.createDataFrame([*rows, (60, None, "a b"), (61, "", ""), (62, "a", None)], "id int, hyp string, ref string").coalesce(1)
    found = []
    for size in (1, 50, 1 << 20):
        monkeypatch.setattr(B, "TEXT_BYTES", size)
        found.append(sorted(map(str, B.bleu_stats(df, "none").collect())))
    assert found[0] == found[1] == found[2]


def test_evaluation_counts_once(spark, monkeypatch):
    from bitexture.plans import jobs

    written = []
    monkeypatch.setattr(jobs, "stored", lambda df, name, put=jobs.stored: written.append(name) or put(df, name))
    df = spark.createDataFrame([(1, "A B C D", "a b c d"), (2, "X", "y")], "id int, src string, tgt string")
    out = jobs.evaluate(df, lambda: str.lower, "none", k=1)
    assert len(written) == 1 and out.sentences.columns == ["id", "hyp", "ref", "score"]
    assert "ArrowEvalPython" not in out.corpus._jdf.queryExecution().executedPlan().toString()


def python_search(start, table, k, max_len, eos=3, alpha=0.7):
    def rate(lp, tokens):
        return round(lp / len(tokens) ** alpha, 6)

    beams, done = [(0.0, start)], []
    for _ in range(max_len):
        cands = []
        for lp, tokens in beams:
            nexts = sorted(table.get(tokens[-1], {}).items(), key=lambda kv: (-kv[1], kv[0]))[:k]
            cands += [(round(lp + p, 6), tokens + [n]) for n, p in nexts]
        cands.sort(key=lambda c: (-rate(*c), c[1]))
        done += [c for c in cands if c[1][-1] == eos]
        beams = [c for c in cands if c[1][-1] != eos][:k]
        if not beams:
            break
    pool = done or beams
    best = min(pool, key=lambda c: (-rate(*c), c[1]))
    return [t for t in best[1] if t not in (0, 2, 3)]


@pytest.mark.parametrize("k,max_len", [(1, 4), (3, 6), (5, 3)])
def test_decode_corpus(spark, k, max_len):
    rng = random.Random(k)
    table = {p: {n: round(-rng.random() * 3, 6) for n in rng.sample(range(3, 12), 6)} for p in range(2, 12) if p != 3}
    scores = spark.createDataFrame(
        [(p, n, lp) for p, row in table.items() for n, lp in row.items()], "prev int, next int, logprob double"
    )
    starts = [(i, [2, 4 + i % 8]) for i in range(16)]
    sources = spark.createDataFrame(starts, "src_id int, tokens array<int>")
    got = {r.src_id: r.ids for r in H.decode_corpus(sources, scores, k, max_len).collect()}
    assert got == {i: python_search(s, table, k, max_len) for i, s in starts}


def test_greedy_next(spark):
    df = spark.createDataFrame([(1, 5, -1.0), (1, 4, -1.0), (1, 9, -2.0)], "prev int, next int, logprob double")
    assert [tuple(r) for r in H.greedy_next(df).collect()] == [(1, 4, -1.0)]


def test_every_source_is_answered(spark):
    from bitexture.operators.search import decode_corpus

    scores = spark.createDataFrame([(5, 6, -0.5), (6, 3, -0.1), (7, 8, -0.2)], "prev int, next int, logprob double")
    sources = spark.createDataFrame([(1, [5]), (2, [99]), (3, [7]), (4, [3])], "src_id bigint, tokens array<int>")
    got = {r.src_id: (r.state, r.ids) for r in decode_corpus(sources, scores, k=2, max_len=5).collect()}
    assert got == {1: ("finished", [5, 6]), 2: ("live", [99]), 3: ("live", [7, 8]), 4: ("finished", [])}


@pytest.mark.parametrize("k,max_len", [(1, 4), (3, 6), (5, 12)])
def test_sources_with_scores_of_their_own(spark, k, max_len):
    rng = random.Random(k)
    tables = {
        i: {p: {n: round(-rng.random() * 3, 6) for n in rng.sample(range(3, 12), 6)} for p in range(2, 12) if p != 3}
        for i in range(12)
    }
    rows = [(i, p, n, lp) for i, t in tables.items() for p, row in t.items() for n, lp in row.items()]
    scores = spark.createDataFrame(rows, "src_id int, prev int, next int, logprob double")
    sources = spark.createDataFrame([(i, [2, 5]) for i in tables], "src_id int, tokens array<int>")
    found = H.decode_corpus(sources, scores, k, max_len)
    got = {r.src_id: r.ids for r in found.collect()}
    # the same first token, but scores of their own
    assert got == {i: python_search([2, 5], t, k, max_len) for i, t in tables.items()}
    assert len({tuple(v) for v in got.values()}) > 6
    first = {(r.src_id, r.tokens[-1]) for r in H.beam_expand(sources.selectExpr("src_id", "0D AS log_prob", "tokens"), scores, k).collect()}
    assert first == {(i, n) for i, t in tables.items() for n in sorted(t[5], key=lambda n: (-t[5][n], n))[:k]}


def test_no_exchange_per_position(spark):
    scores = spark.createDataFrame([(1, 5, 6, -0.5)], "src_id bigint, prev int, next int, logprob double")
    sources = spark.createDataFrame([(1, [5])], "src_id bigint, tokens array<int>")
    plans = [H.decode_corpus(sources, scores, 2, n)._jdf.queryExecution().executedPlan().toString() for n in (2, 64)]
    assert plans[0].count("Exchange") == plans[1].count("Exchange") <= 4


def test_every_source_is_answered_by_its_own_scores(spark):
    scores = spark.createDataFrame(
        [(1, 5, 6, -0.5), (1, 6, 3, -0.1), (3, 7, 8, -0.2), (4, 3, 9, -0.1), (5, 5, 7, -0.5)], "src_id bigint, prev int, next int, logprob double"
    )
    sources = spark.createDataFrame([(1, [5]), (2, [5]), (3, [7]), (4, [3]), (5, [5])], "src_id bigint, tokens array<int>")
    got = {r.src_id: (r.state, r.ids) for r in H.decode_corpus(sources, scores, k=2, max_len=5).collect()}
    assert got == {1: ("finished", [5, 6]), 2: ("live", [5]), 3: ("live", [7, 8]), 4: ("finished", []), 5: ("live", [5, 7])}


def test_sources_search_together_with_ties(spark, monkeypatch):
    """The same answers however many sources advance together, for starts of
    several lengths and scores with many ties; no expression of the search is
    evaluated position by position within the row."""
    rng = random.Random(4)
    tables = {i: {p: {n: -rng.randint(1, 3) / 2 for n in rng.sample(range(3, 9), 4)} for p in range(2, 9) if p != 3} for i in range(40)}
    rows = [(i, p, n, lp) for i, t in tables.items() for p, row in t.items() for n, lp in row.items()]
    scores = spark.createDataFrame(rows, "src_id int, prev int, next int, logprob double")
    starts = {i: [2] * (i % 3) + [4 + i % 5] for i in tables}
    sources = spark.createDataFrame(list(starts.items()), "src_id int, tokens array<int>").coalesce(1)
    for together in (1, 7, 512):
        monkeypatch.setattr(H, "TOGETHER", together)
        found = H.decode_corpus(sources, scores, 3, 9)
        assert {r.src_id: r.ids for r in found.collect()} == {i: python_search(s, tables[i], 3, 9) for i, s in starts.items()}
    assert "lambdafunction(" not in found.select("score")._jdf.queryExecution().optimizedPlan().toString()


def test_bigrams_of_documents_are_not_shuffled(spark):
    from bitexture.plans import inputs as I

    ids = spark.createDataFrame([(1 << 32, [5, 6, 5]), (2 << 32, [5])], "line_no bigint, ids array<int>")
    found = I.document_bigrams_of(ids)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert sorted((r.src_id, r.prev, r.next, r.n) for r in found.collect() if r.src_id == 2) == [(2, 2, 5, 1), (2, 5, 3, 1)]


@pytest.mark.parametrize("n", [1, 2, 3])
def test_ngrams_of_rows_and_of_repeated_keys(spark, monkeypatch, n):
    monkeypatch.setattr(B, "GRAM_TOKENS", 40)
    rng = random.Random(n)
    rows = [(i, [rng.choice(["a", "b", "\u00e9", ""]) for _ in range(rng.randint(0, 30))]) for i in range(60)]
    rows += [(3, list("abab")), (3, list("ab")), (7, []), (None, list("aba")), (None, list("ba")), (61, None)]
    rows += [(70, ["a b", "c", "a", "b c", "a b", "c"]), (71, ["a", None, "a", "b", None, "a"]), (72, list("ab") * 100)]
    want = Counter()
    for i, tokens in rows:
        for gram in zip(*[(tokens or [])[k:] for k in range(n)]):
            want[i, " ".join(t for t in gram if t is not None) if n > 1 else gram[0]] += 1
    df = spark.createDataFrame(rows, "id bigint, tokens array<string>").repartition(3)
    got = B.ngram_counts(df, n).collect()
    assert len(got) == len(want) and {(r.id, r.gram): r.n for r in got} == want


def test_ngrams_of_rows_of_their_own_are_not_shuffled(spark):
    df = spark.createDataFrame([(1, list("abab")), (2, list("ba"))], "id bigint, tokens array<string>")
    out = B.ngram_counts(df, 2)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, out.collect())) == [(1, "a b", 2), (1, "b a", 1), (2, "b a", 1)]


def test_one_step_counts_the_bigrams_it_can_take(spark, sf):
    """Scores of a beam's continuations are those of the full table; no others are counted or shuffled."""
    from bitexture.operators import tokens as K
    from bitexture.plans import inputs as I

    lines = [(1 << 32, [5, 6, 5, 7, 5]), ((1 << 32) + 1, [6, 5, 6]), (2 << 32, [5]), (3 << 32, []), (4 << 32, [2, 3, 3])]
    ids = spark.createDataFrame(lines, "line_no bigint, ids array<int>")
    beams = spark.createDataFrame([(1, [2, 5]), (1, [2, 7]), (2, [2, 5]), (4, [2, 3]), (9, [2, 5])], "src_id bigint, tokens array<int>")
    wanted = {(r.src_id, r.tokens[-1]) for r in beams.collect()}
    full = {tuple(r) for r in I.document_bigrams_of(ids).collect()}
    got = [tuple(r) for r in I.document_bigrams_of(ids, beams).collect()]
    assert sorted(got) == sorted(r for r in full if r[:2] in wanted) and len(got) < len(full)
    step = lambda scores: sorted(map(str, H.beam_expand(beams.withColumn("log_prob", F.lit(0.0)), scores).collect()))
    assert step(I.document_bigrams_of(ids, beams)) == step(I.document_bigrams_of(ids))
    rows = spark.createDataFrame([(2, list("abab"), ["b"]), (3, list("ba"), ["a", "b"])], "n bigint, symbols array<string>, l array<string>")
    counts = {(r.left, r.right): r.n for r in K.symbol_pair_counts(rows, lefts="l").collect()}
    assert counts == {("b", "a"): 5}
