"""Near-duplicate groups against brute force: templates, repeated ids, prefixes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from bitexture.llm import pipeline, simhash
from bitexture.llm.shingles import Shingler


def brute(rows, similarity=0.8):
    """Smallest id of the group of each row (id, text)."""
    sets = {}
    for i, t in rows:
        sets.setdefault(frozenset(Shingler(5)(t).tolist()), []).append(i)
    names = list(sets)
    root = list(range(len(names)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(names)):
        for j in range(i):
            a, b = names[i], names[j]
            if len(a & b) >= similarity * len(a | b) - 1e-9 and find(i) != find(j):
                root[find(i)] = find(j)
    least = {}
    for i, name in enumerate(names):
        least[find(i)] = min(least.get(find(i), 10**18), *sets[name])
    return sorted((d, least[find(i)]) for i, name in enumerate(names) for d in sets[name])


def variants(rng, n, words, changes, first=0):
    base = [f"t{first}w{x}" for x in range(words)]
    out = []
    for i in range(n):
        text = list(base)
        for at in rng.choice(words, changes, replace=False):
            text[at] = f"own{first}x{i}x{at}"
        out.append((first + i, " ".join(text)))
    return out


@pytest.mark.parametrize("changes", [1, 2, 4])
def test_variants_of_a_template(spark, make_docs, changes, monkeypatch):
    """All near copies, some, or none: found exactly, with few candidates."""
    asked = []
    real = simhash.resembling

    def counted(pairs, sets, similarity):
        asked.append(pairs.count())
        return real(pairs, sets, similarity)

    monkeypatch.setattr(simhash, "resembling", counted)
    rows = variants(np.random.default_rng(changes), 300, 150, changes)
    got = sorted((r.doc_id, r.component_id) for r in simhash.near_groups(make_docs(rows)).collect())
    assert got == brute(rows)
    # 44 850 pairs in all
    assert sum(asked) < 40 * len(rows)


def test_prefixes_find_every_pair(spark, make_docs):
    """Without bands: the prefixes alone, over several groups and sizes."""
    rng = np.random.default_rng(4)
    rows = [r for g in range(5) for r in variants(rng, 25, 40 + 30 * g, 1 + g % 3, 1000 * g)]
    rows += [(9000 + i, " ".join(t.split()[: 150 - 6 * i])) for i, (_, t) in enumerate(variants(rng, 1, 150, 0, 9000) * 12)]
    found = [(i, sorted(set(Shingler(5)(t).view(np.int64).tolist()))) for i, t in rows]
    sets = spark.createDataFrame(found, "node bigint, __set array<bigint>")
    members = simhash.prefix_members(sets, 0.8)
    roots = simhash.linked_members(members, 0.8, lambda p: simhash.resembling(p, sets, 0.8), None, simhash._first_shared(0.8))
    named = {r.node: r.root for r in roots.collect()}
    want = brute(rows)
    assert sorted((i, named.get(i, i)) for i, _ in rows) == want and len({r for _, r in want}) > 5


def test_repeated_ids_lose_no_text(spark, make_docs, sf):
    rng = np.random.default_rng(7)
    a, b, c, d = (" ".join(f"{n}{x}" for x in rng.integers(0, 900, 80)) for n in "abcd")
    docs = make_docs([(1, a), (5, a), (5, b), (8, c), (8, d), (9, c), (None, a), (None, None), (3, None), (4, ""), (4, ""), (7, d + "!"), (6, a), (6, a)])
    docs = docs.selectExpr("*", "1 AS text_md5", "2 AS first")
    out = pipeline.near_duplicates(spark, docs, sf)
    assert out.columns == docs.columns
    kept = sorted(((r.doc_id or 0), r.text or "") for r in out.collect())
    assert kept == sorted([(1, a), (5, b), (8, c), (7, d + "!"), (0, a), (0, ""), (3, "")])
    twice = pipeline.near_duplicates(spark, make_docs([(2, a), (2, a), (2, b), (2, b)]), sf)
    assert sorted((r.doc_id, r.text) for r in twice.collect()) == [(2, a), (2, b)]
    strings = make_docs([(1, a), (2, a), (3, b)]).withColumn("doc_id", F.concat(F.lit("x"), "doc_id"))
    got = {r.doc_id: (r.component_id, r["first"]) for r in simhash.near_groups(strings).collect()}
    assert got == {"x1": ("x1", True), "x2": ("x1", False), "x3": ("x3", True)}


def test_set_prints_are_majorities():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 2**63, 101, dtype=np.uint64) * np.uint64(2)
    bits = (h[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
    assert simhash.set_print(h) == sum(1 << i for i in range(64) if bits[:, i].sum() * 2 > len(h))
    assert simhash.set_print(h[:0]) == 0
