"""Token counts against the tokenizer library on whole texts."""

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from bitexture.llm import token_counts as tc
from bitexture.llm.queries import QUERIES, TOKENIZER

PATH = public_tokenizers.path(TOKENIZER)


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda text: len(tokenizer.encode(text or "", add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def counter():
    with open(PATH, "rb") as f:
        data = f.read()
    return tc.load_counter("test", ".json", lambda: data)


SIGNS = [*"ab's.!|<>09 \n\t\x1c\x1f\x85\xa0 ​éß漢字。、가😀́", "<|endoftext|>", "endoftext", "'re", "a" * 300, "漢" * 200 + "。"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(SIGNS), max_size=40).map("".join) | st.text(max_size=60))
def test_pieces_add_up(library, counter, text):
    count, cuts = counter
    assert "".join(tc.safe_pieces(text, cuts)) == text
    assert tc.count_tokens([text], count, cuts, {}) == [library(text)]


def test_query_counts_whole_texts(spark, sf, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op13_token_counts"].run(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_bytes, r.n_tokens) == (len((texts[r.doc_id] or "").encode()), library(texts[r.doc_id]))
        assert r.over_limit == (r.n_tokens > 512)


def test_odd_rows(spark, odd_docs, library):
    docs = odd_docs.selectExpr("*", "1 AS n_tokens", "2 AS tokens")
    rows = tc.with_token_counts(docs, PATH, 10).collect()
    assert len(rows) == docs.count() and {r.tokens for r in rows} == {2}
    for r in rows:
        assert r.n_tokens == library(r.text) and r.n_bytes == len((r.text or "").encode())
    assert tc.with_token_counts(odd_docs.limit(0), PATH, 10).collect() == []
    with pytest.raises(ValueError):
        tc.with_token_counts(odd_docs, "words.txt", 10)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_kinds_get_whole_texts(spark, make_docs, name):
    texts = ["Hello  World, it's 2024!", "漢字 <|endoftext|> and </s>", "", "x" * 5000]
    rows = tc.with_token_counts(make_docs(list(enumerate(texts))), public_tokenizers.path(name), 10).collect()
    if name.endswith(".json"):
        tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        tokenizer.no_truncation()
        want = [len(tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]
    else:
        import sentencepiece

        want = [len(ids) for ids in sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name)).encode(texts)]
    assert [r.n_tokens for r in sorted(rows, key=lambda r: r.doc_id)] == want


def test_batches_hold_bytes_not_rows():
    texts = ["é" * 10] * 7 + ["x" * 100] + ["y"]
    assert [len(b) for b in tc.batches_by_bytes(texts, 50)] == [3, 3, 2, 1]
