"""Vocabularies and byte pairs, also against the public tokenizer library."""

import random
import re

import pytest
from pyspark.sql import functions as F

from bitexture.operators import bpe as B
from bitexture.operators import tokens as K
from bitexture.sources.tokenizers import read_tokenizer, write_tokenizer

CORPUS = [
    "the cat sat on the mat, the end...",
    "aaa aaaa aaaaa abab ababab",
    "Xin ch\u00e0o b\u1ea1n, b\u1ea1n c\u00f3 kh\u1ecfe kh\u00f4ng?",
    "\u4eca\u65e5\u306f\u826f\u3044\u5929\u6c17\u3067\u3059\u306d\u3002\u4eca\u65e5\u306f",
    "low lower lowest newer newest widest wide",
    "<2vi> the lowest <2ja> \U0001f600\U0001f600!",
]


def corpus(n=400, seed=2):
    rng = random.Random(seed)
    syllables = ["an", "ba", "the", "en", "lo", "we", "st", "er", "\u00e9a", "\u1ea1n", "ing", "o"]
    words = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(150)]
    return CORPUS + [" ".join(rng.choice(words) for _ in range(rng.randint(1, 12))) for _ in range(n)]


def library(texts, size, tmp_path, min_frequency=2):
    from tokenizers import Tokenizer
    from tokenizers.models import BPE
    from tokenizers.pre_tokenizers import Whitespace
    from tokenizers.processors import TemplateProcessing
    from tokenizers.trainers import BpeTrainer

    tok = Tokenizer(BPE(unk_token="[UNK]"))
    tok.pre_tokenizer = Whitespace()
    trainer = BpeTrainer(
        vocab_size=size, min_frequency=min_frequency, special_tokens=list(K.SPECIAL_TOKENS), show_progress=False
    )
    tok.train_from_iterator(texts, trainer)
    tok.post_processor = TemplateProcessing(single="[BOS] $A [EOS]", special_tokens=[("[BOS]", 2), ("[EOS]", 3)])
    return tok


@pytest.fixture(scope="module")
def trained(spark, tmp_path_factory):
    texts = corpus()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    return texts, df, B.train_bpe(df, vocab_size=220), library(texts, 220, tmp_path_factory.mktemp("tok"))


def test_training_agrees_with_the_library(trained):
    _, _, model, tok = trained
    ours = {r.token: r.id for r in model.vocab.collect()}
    assert ours == tok.get_vocab()


def test_encoding_agrees_with_the_library(spark, trained):
    texts, _, model, tok = trained
    extra = texts + ["unseen \u00fc\u00fc words [PAD]x[EOS]! foo__src_en__bar", "", "   ", "\u0928\u092e\u0938\u094d\u0924\u0947 x"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(extra)], "id int, text string").repartition(3)
    got = {r.id: r.ids for r in B.bpe_encode(df, model).collect()}
    assert {i: got[i] for i in got} == {i: tok.encode(t).ids for i, t in enumerate(extra)}
    back = {r.id: r.text2 for r in B.bpe_decode(B.bpe_encode(df, model), model, name="text2").collect()}
    assert all(back[i] == tok.decode(tok.encode(t).ids) for i, t in enumerate(extra))


def test_minimum_frequency_stops(spark, tmp_path):
    texts = ["ab ab cd", "ef"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    model = B.train_bpe(df, vocab_size=100)
    assert [r.merged for r in model.merges.collect()] == ["ab"]
    assert {r.token: r.id for r in model.vocab.collect()} == library(texts, 100, tmp_path).get_vocab()


def test_larger_vocabularies_agree(spark, tmp_path):
    texts = corpus(200, seed=9)
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for size in (60, 150, 600):
        model = B.train_bpe(df, vocab_size=size)
        assert {r.token: r.id for r in model.vocab.collect()} == library(texts, size, tmp_path).get_vocab()


@pytest.mark.parametrize("top,stretches", [(1, 10), (3, 10**6), (40, 25), (4_096, 10**6)])
def test_any_number_of_pairs_per_round_gives_the_same_merges(spark, tmp_path, monkeypatch, top, stretches):
    """Few pairs a round, or more pieces of words than the driver may hold."""
    monkeypatch.setattr(B, "TOP_PAIRS", top)
    monkeypatch.setattr(B, "MAX_STRETCHES", stretches)
    texts = corpus(40, seed=3) + ["aaaa aaaaaaa baaaab abababa", "aaa", "abcabcabc bcbc cabab"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    size = 75
    model = B.train_bpe(df, vocab_size=size)
    assert {r.token: r.id for r in model.vocab.collect()} == library(texts, size, tmp_path).get_vocab()


def test_a_merge_with_a_known_text_ends_the_round():
    symbols = B._Symbols([], [ord(c) for c in "abc"], 100)
    a, b, c = (ord(x) for x in "abc")
    # ab + c and a + bc are one symbol
    merges = B.certain_merges([([a, b, c], 5), ([b, c], 6), ([a, b], 7), ([a, b, c], 9)], None, 1, symbols)
    assert len(merges) == len(symbols.merges) > 1
    assert all(symbols.code_text[t] == symbols.code_text[x] + symbols.code_text[y] for x, y, t in merges)


def test_tokenizer_round_trip(spark, trained, tmp_path):
    _, df, model, tok = trained
    write_tokenizer(model, f"{tmp_path}/tok", 2, "corpus.txt")
    tokenizer = B.Tokenizer(read_tokenizer(spark, f"{tmp_path}/tok"))
    assert (tokenizer.pad_id, tokenizer.bos_id, tokenizer.eos_id, tokenizer.vocab_size) == (0, 2, 3, tok.get_vocab_size())
    a = tokenizer.encode(df).orderBy("id").collect()
    assert a == B.bpe_encode(df, model).orderBy("id").collect()
    decoded = tokenizer.decode(tokenizer.encode(df), name="back").select("id", "back").orderBy("id").collect()
    assert decoded[0].back == tok.decode(tok.encode(CORPUS[0]).ids)


def test_encode_dataset_has_fixed_length(spark, trained):
    _, df, model, _ = trained
    pairs = df.select("id", F.concat(F.lit("<2vi> "), "text").alias("src"), F.col("text").alias("tgt"))
    out = B.encode_dataset(pairs, model, length=12)
    assert out.where((F.size("src_ids") != 12) | (F.size("tgt_ids") != 12)).isEmpty()
    assert out.count() == df.count()


def test_pretokenize_keeps_specials(spark):
    df = spark.createDataFrame([("a[PAD]b ![EOS]? x__src_en__",)], "t string")
    words = df.select(K.pretokenize(F.col("t"), K.SPECIAL_TOKENS)).head()[0]
    assert words == ["a", "[PAD]", "b", "!", "[EOS]", "?", "x", "__src_en__"]


def test_texts_without_specials_take_the_plain_pattern(spark):
    """Same words either way; looking ahead is only for texts that hold one."""
    texts = ["a[PAD]b ![EOS]? x__src_en__", "__src_ en__ [PAD [ PAD]", "plain text, no marks...", "", None, "\u00e9t\u00e9_1 [unk]"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    found = df.select("id", K.pretokenize(F.col("t"), K.SPECIAL_TOKENS).alias("s"), K.pretokenize(F.col("t")).alias("p"))
    rows = {r.id: r for r in found.collect()}
    assert rows[0].s == ["a", "[PAD]", "b", "!", "[EOS]", "?", "x", "__src_en__"] and rows[4].s is None
    assert all(rows[i].s == rows[i].p for i in (1, 2, 3, 4, 5))
    assert "Contains" in found._jdf.queryExecution().optimizedPlan().toString()


def test_kept_words_are_bounded(spark, trained, monkeypatch):
    texts, df, model, tok = trained
    monkeypatch.setattr(B, "KEPT_WORDS", 3)
    got = {r.id: r.ids for r in B.bpe_encode(df, model).collect()}
    assert got == {i: tok.encode(t).ids for i, t in enumerate(texts)}


def test_vocab_lookup(spark):
    df = spark.createDataFrame([(1, ["a", "b", "zz", "a"]), (2, []), (3, None)], "id int, tokens array<string>")
    vocab = K.build_vocab(spark.createDataFrame([("a", 5), ("b", 5), ("c", 1)], "token string, n bigint"), 6)
    assert {r.token: r.id for r in vocab.collect()} == {"[PAD]": 0, "[UNK]": 1, "[BOS]": 2, "[EOS]": 3, "a": 4, "b": 5}
    ids = K.vocab_lookup(df.repartition(2), vocab)
    assert {r.id: r.ids for r in ids.collect()} == {1: [4, 5, 1, 4], 2: [], 3: []}
    text = K.decode_text(ids, vocab, special_ids=[1])
    assert {r.id: r.text for r in text.collect()} == {1: "a b a", 2: "", 3: ""}


def test_symbol_pairs(spark):
    df = spark.createDataFrame([(3, list("abab")), (2, list("a")), (1, [])], "n bigint, symbols array<string>")
    got = {(r.left, r.right): r.n for r in K.symbol_pair_counts(df).collect()}
    assert got == {("a", "b"): 6, ("b", "a"): 3}


def test_word_pattern_is_the_library_pattern(spark):
    from tokenizers.pre_tokenizers import Whitespace

    df = spark.createDataFrame([(t,) for t in corpus(20)], "t string")
    for t, words in df.select("t", K.pretokenize(F.col("t"))).collect():
        assert words == [w for w, _ in Whitespace().pre_tokenize_str(t)]
        assert not re.search(r"\s", "".join(words))


def test_large_corpora_begin_with_few_pairs(spark, tmp_path, monkeypatch):
    """More words than the driver may hold: rounds grow from a few pairs; words
    of a batch are handled a few symbols at a time."""
    monkeypatch.setattr(B, "FIRST_PAIRS", 2)
    monkeypatch.setattr(B, "MAX_STRETCHES", 60)
    monkeypatch.setattr(B, "SLICE_SYMBOLS", 50)
    texts = corpus(60, seed=5) + ["aaaa aaaaaaa baaaab abababa", "abcabcabc bcbc cabab " + "ab" * 200]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    taken = []
    stretches = B._stretches
    monkeypatch.setattr(B, "_stretches", lambda words, pairs: taken.append(len(pairs)) or stretches(words, pairs))
    model = B.train_bpe(df, vocab_size=90)
    assert {r.token: r.id for r in model.vocab.collect()} == library(texts, 90, tmp_path).get_vocab()
    assert taken[:2] == [2, 8]


def test_a_training_step_runs_python_once(spark):
    """Words go to one Python worker per task, and are not computed again to filter them."""
    words = spark.createDataFrame([(3, [1, 2, 1, 2, 3]), (2, [1, 2]), (1, [5, 5, 5]), (4, [7])], "n bigint, codes array<int>")
    steps = {
        "merged": B._merged(words, [(1, 2, 9), (9, 9, 10), (5, 5, 11)]),
        "stretches": B._stretches(words, [(1, 2), (2, 1)]),
        "pairs": B._pair_counts(words),
    }
    for df in steps.values():
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInArrow") == 1 and "ArrowEvalPython" not in plan
    assert sorted((tuple(r.codes), r.n) for r in steps["merged"].collect()) == [((10, 3), 3), ((11, 5), 1)]
    assert sorted((tuple(r.codes), r.n) for r in steps["stretches"].collect()) == [((1, 2), 2), ((1, 2, 1, 2), 3)]
    counts = {(r.left, r.right): r.n for r in steps["pairs"].collect()}
    assert counts == {(1, 2): 8, (2, 1): 3, (2, 3): 3, (5, 5): 2}


def test_merged_words_are_those_of_one_merge_at_a_time(spark):
    rng = random.Random(8)
    words = [[rng.choice("aab") for _ in range(rng.randint(2, 30))] for _ in range(200)]
    codes = [[ord(c) for c in w] for w in words]
    merges = [(97, 97, 200), (200, 97, 201), (98, 200, 202), (202, 98, 203), (97, 98, 204), (203, 203, 205)]
    want = []
    for i, c in enumerate(codes):
        for merge in merges:
            c = B._replaced(c, *merge)
        want += [(i, c)] if len(c) > 1 else []
    df = spark.createDataFrame(list(enumerate(codes)), "n bigint, codes array<int>").repartition(3)
    assert sorted((r.n, r.codes) for r in B._merged(df, merges).collect()) == want


def test_words_reach_a_task_in_bounded_slices(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(B, "SLICE_SYMBOLS", 10)
    words = [[i] * size for i, size in enumerate([3, 4, 2, 30, 1, 1, 9, 10, 5])]
    batch = pa.RecordBatch.from_arrays([pa.array(words, pa.list_(pa.int32())), pa.array(range(len(words)))], names=["codes", "n"])
    parts = [(codes.to_pylist(), n.tolist()) for codes, n in B._slices(iter([batch, batch.slice(2, 4)]))]
    sizes = [[len(w) for w in codes] for codes, _ in parts]
    assert all(sum(x) - max(x) <= B.SLICE_SYMBOLS for x in sizes)
    assert [w for codes, _ in parts for w in codes] == words + words[2:6]
    assert [i for _, n in parts for i in n] == [*range(9), *range(2, 6)]


def test_the_first_merges_take_one_count_of_words(spark, sf, monkeypatch):
    from bitexture.plans import token_queries as Q

    calls = []
    count = K.word_freq
    for module in (K, B):
        monkeypatch.setattr(module, "word_freq", lambda *a: calls.append(a) or count(*a))
    assert Q.train_bpe_merges(spark, sf).count() == Q._MERGES
    assert len(calls) == 1
