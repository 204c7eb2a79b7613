"""Registered queries against SQL or a brute-force version on small tables."""

import hashlib
import html
import re
import zlib
from collections import Counter, defaultdict

import compare
import duckdb
import pytest
import xxhash

from bitexture.llm.queries import QUERIES, URL_RULES


@pytest.fixture(scope="module")
def con(sf):
    return compare.duck(sf)


@pytest.fixture(scope="module")
def docs(con):
    return dict(con.sql("SELECT doc_id, text FROM documents").fetchall())


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql])
def test_same_as_sql(spark, con, sf, name):
    assert compare.compare(spark, con, sf, name, QUERIES[name]) == "ok"


def test_fingerprints(spark, sf, docs):
    ids = sorted(docs)
    rows = {r.doc_id: r for r in QUERIES["op1_fingerprints"].run(spark, sf).collect()}
    assert len(rows) == len(ids)
    for here, after in zip(ids, ids[1:] + ids[:1]):
        text, half = docs[here], len(docs[here]) // 2
        edited = text[: len(text) - half] + docs[after][:half]
        assert rows[here].n_chars == len(text)
        assert rows[here].edited_sha256 == sha(edited)
        assert 0 <= rows[here].near_edited <= 1 and 0 <= rows[here].near_next <= 1
        runs = [w[i : i + 5] for w in [[x for x in re.split(r"[\x20\x09-\x0d]+", text.lower()) if x]] for i in range(max(1, len(w) - 4))]
        signed = sorted(_chained(r) for r in {tuple(r) for r in runs} if r)
        assert rows[here].fingerprint == "".join(f"{h % 2**64:016x}" for h in signed[:128])


def _chained(words):
    seed = 42
    for w in words:
        seed = xxhash.xxh64_intdigest(w.encode(), seed)
    return seed - 2**64 if seed >= 2**63 else seed


def test_main_text(spark, sf, con):
    pages = dict(con.sql("SELECT page_id, html FROM pages").fetchall())
    for r in QUERIES["op2_html_text"].run(spark, sf).collect():
        found = re.search(r"<article>(.*?)(</article>|$)", pages[r.page_id], re.S)
        body = re.sub(r"<[^>]*$", "", found[1])
        parts = re.split(r"</?(?:p|h1)>", re.sub(r"<br>", " ", re.sub(r"</?b>", "", body)))
        blocks = [" ".join(html.unescape(p).split()) for p in parts]
        assert r.text == "\n\n".join(b for b in blocks if b)
        assert r.n_chars == len(r.text)


def test_toxicity(spark, con):
    sf = "/root/testdata/sf0.1"  # the smaller ones have few toxic rows to learn from
    labels = dict(duckdb.sql(f"SELECT doc_id, toxic FROM '{sf}/labels.parquet'").fetchall())
    rows = QUERIES["op3_toxicity"].run(spark, sf).collect()
    assert len(rows) == duckdb.sql(f"SELECT count(*) FROM '{sf}/documents.parquet'").fetchall()[0][0]
    seen = Counter()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
        if r.held_out and r.doc_id in labels:
            seen[labels[r.doc_id], r.predicted] += 1
    assert seen[0, 0] + seen[1, 1] > 0.95 * seen.total()
    assert seen[0, 1] <= 0.01 * seen[0, 0] and seen[1, 1] > 0.75 * (seen[1, 0] + seen[1, 1])


def test_secrets(spark, sf, docs):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    for r in QUERIES["op4_secret_scan"].run(spark, sf).collect():
        text = docs[r.doc_id]
        spans = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
        spans += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        spans += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
        kinds = Counter(k for _, k, _ in spans)
        assert (r.n_assign, r.n_access, r.n_hex) == (kinds[0], kinds[1], kinds[2])
        base = [f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(spans)]
        assert r.base_sha256 == sha(",".join(base))
        assert set(base) <= set(r.spans.split(",")) | {""}


def test_mixture(spark, sf, docs):
    rows = QUERIES["op6_mix_sources"].run(spark, sf).collect()
    assert {r.doc_id for r in rows} == set(docs)
    by_slot = defaultdict(list)
    for r in rows:
        by_slot[r.mix_slot].append(r)
        assert r.mix_release <= r.mix_slot < r.mix_deadline
    assert sorted(by_slot) == list(range(len(by_slot)))
    assert all(len({(r.source, r.mix_block) for r in at}) == 1 for at in by_slot.values())
    assert all(sorted(r.mix_row for r in at) == list(range(len(at))) for at in by_slot.values())


def test_shards(spark, sf, docs, con):
    source = dict(con.sql("SELECT doc_id, source FROM documents").fetchall())
    rows = QUERIES["op7_stratified_shards"].run(spark, sf).collect()
    shards = defaultdict(list)
    for r in rows:
        raw = docs[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
        shards[r.shard].append(r)
    assert len(rows) == len(docs) and sorted(shards) == list(range(8))
    assert max(map(len, shards.values())) - min(map(len, shards.values())) <= 1
    for at in shards.values():
        assert sorted(r.slot for r in at) == list(range(len(at)))
    total = Counter(source.values())
    for at in shards.values():
        here = Counter(source[r.doc_id] for r in at)
        assert all(abs(here[s] - n / 8) <= 2 for s, n in total.items())


def test_benchmark_overlap(spark, sf, docs, con):
    def runs(text):
        w = re.findall(r"\w+", text.lower())
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    items = {i: runs(t) for i, t in con.sql("SELECT item_id, text FROM benchmark").fetchall()}
    want = {(d, i) for d, t in docs.items() for s in [runs(t)] for i, m in items.items() if len(m & s) >= 0.8 * len(m)}
    got = QUERIES["op8_benchmark_overlap"].run(spark, sf).collect()
    assert want and {(r.doc_id, r.item_id) for r in got} == want


def test_simhash_groups(spark, sf, docs):
    prints = {}
    for i, t in docs.items():
        w = t.encode().lower().split()
        runs = [b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
        hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(runs))
    root = {i: i for i in docs}
    ids, changed = sorted(docs), True
    near = [(a, b) for a in ids for b in ids if a < b and (prints[a] ^ prints[b]).bit_count() <= 2]
    while changed:
        changed = False
        for a, b in near:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    got = QUERIES["op9_simhash"].run(spark, sf).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{prints[i]:016x}", root[i]) for i in ids}


def test_url_verdicts(spark, sf, con):
    urls = dict(con.sql("SELECT page_id, url FROM pages").fetchall())
    rows = QUERIES["op10_url_filter"].run(spark, sf).collect()
    listed = {r.canonical for r in rows if r.page_id % 100 == 0}
    assert len(rows) == len(urls)
    for r in rows:
        rest = urls[r.page_id].split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
        fits = [(len(h + p), h + p, v) for v, h, p in URL_RULES if (f".{host.lower()}").endswith(f".{h}") and path.startswith(p)]
        rule = max(fits, default=(0, None, "block" if r.canonical in listed else "allow"))
        assert (r.host, r.path, r.rule, r.verdict) == (host.lower(), path, rule[1], rule[2])
        assert r.listed == (r.canonical in listed)
