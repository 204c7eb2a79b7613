"""Every stage of the pipeline against a brute-force version on its own input."""

import re
from collections import Counter

import corpus_pipeline
import pytest


def runs(text):
    w = re.findall(r"\w+", (text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def likeness(a, b):
    return len(a & b) / len(a | b)


@pytest.fixture(scope="module")
def tables(spark, sf, tmp_path_factory):
    """The input and the output of each stage, by its name."""
    folder, docs, out = tmp_path_factory.mktemp("pipeline"), spark.read.parquet(f"{sf}/documents.parquet"), {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{folder}/{i}")
        after = spark.read.parquet(f"{folder}/{i}")
        out[name] = (docs.collect(), after.collect(), after.columns)
        docs = after
    return out


def test_columns(tables):
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    columns = [c for _, _, c in tables.values()]
    assert all(c == names for c in columns[:-1]) and columns[-1] == [*names, "shard", "slot"]


def test_rows_are_those_of_the_input(tables):
    for before, after, _ in tables.values():
        assert {tuple(r)[:5] for r in after} <= {tuple(r)[:5] for r in before}


def test_one_of_each_group_stays(tables):
    before, after, _ = tables["simhash near-dedup"]
    kept = {r.doc_id for r in after}
    sets = {r.doc_id: runs(r.text) for r in before}
    assert len({r.text for r in after}) == len(after) and {r.text for r in before} >= {r.text for r in after}
    for d, s in sets.items():
        close = [e for e, t in sets.items() if e != d and likeness(s, t) >= 0.8]
        if d not in kept:
            assert close, "a text of its own went"
        elif d != min([d, *close]):
            # a kept one has no smaller, clearly similar text
            assert not any(e < d for e in close)


def test_benchmark_passages_go(tables, spark, sf):
    before, after, _ = tables["benchmark decontamination"]
    items = [runs(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    leaks = {r.doc_id for r in before for s in [runs(r.text)] if any(len(i & s) >= 0.8 * len(i) for i in items)}
    assert leaks and {r.doc_id for r in after} == {r.doc_id for r in before} - leaks


def test_mixture_and_shards_keep_all(tables):
    before, after, _ = tables["mixing to target weights"]
    assert {r.doc_id for r in after} == {r.doc_id for r in before}
    before, after, _ = tables["sharding"]
    assert Counter(r.doc_id for r in after) == Counter(r.doc_id for r in before)
    sizes = Counter(r.shard for r in after)
    assert len(sizes) == 8 and max(sizes.values()) - min(sizes.values()) <= 1


def test_run(spark, sf, tables):
    rows = corpus_pipeline.run(spark, sf).collect()
    assert sorted((r.doc_id, r.shard, r.slot) for r in rows) == sorted((r.doc_id, r.shard, r.slot) for r in tables["sharding"][1])
