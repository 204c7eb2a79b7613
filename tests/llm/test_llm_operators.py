"""Odd inputs: NULLs, empty and long texts, repeated rows, empty tables, extra
columns with clashing names."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from bitexture.llm import decontamination as D
from bitexture.llm import html_extract, line_dedup, mixing, secret_scan, sharding, simhash, sketches, toxicity, url_filter
from bitexture.llm.components import smallest_reachable
from bitexture.llm.pipeline import STAGES


def test_sketches(spark, odd_docs):
    out = sketches.sketch_documents(odd_docs.withColumn("sketch", F.lit("mine"))).collect()
    assert len(out) == 10
    by = {r.doc_id: r for r in out if r.doc_id is not None}
    assert by[1].sketch == [] and by[2].sketch == [] and len(by[-5].sketch) == 1
    assert by[3].sketch == by[7].sketch and by[3].n_shingles == len(by[3].sketch)
    assert sketches.sketch_documents(odd_docs.limit(0)).collect() == []


def test_sketches_merge_and_estimate(spark):
    df = spark.range(4000).select((F.col("id") % 2).alias("part"), F.xxhash64("id").alias("h"))
    parts = df.groupBy("part").agg(sketches.bottom_k(F.collect_list("h")).alias("s"))
    whole = df.agg(sketches.bottom_k(F.collect_list("h")).alias("s")).first().s
    assert sketches.merge_sketches(parts.withColumn("k", F.lit(1)), ["k"], "s").first().s == whole
    n = spark.createDataFrame([(whole,)], "s array<bigint>").select(sketches.distinct_shingles(F.col("s"))).first()[0]
    assert 2800 < n < 5600
    two = spark.createDataFrame([(list(range(100)), list(range(50)))], "a array<bigint>, b array<bigint>")
    row = two.select(sketches.resemblance(F.col("a"), F.col("b")), sketches.containment(F.col("b"), F.col("a"))).first()
    assert row[0] == 0.5 and row[1] == 1.0


def test_next_row(spark):
    ids = [-(2**50), -3, 0, 1, 63, 64, 5000, 2**33, 2**62]
    df = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id bigint, text string")
    got = {r.doc_id: r.next_text for r in sketches.with_next(df, "doc_id", ["text"]).collect()}
    assert got == {a: f"t{b}" for a, b in zip(ids, ids[1:] + ids[:1])}
    assert sketches.with_next(df.limit(0), "doc_id", ["text"]).collect() == []
    one = sketches.with_next(df.limit(1), "doc_id", ["text"]).first()
    assert one.next_text == one.text


def test_html(spark):
    page = (
        "<html><head><title>No</title><style>x</style></head><body><header>Top</header><nav><a href=/>Menu</a></nav>"
        "<article><h1>A &amp; B</h1><p>One  two<br>three<p>Four <i>five</i></p><aside>Side</aside><script>var a='</p>'</script>"
        "<ul><li>item</li></ul><form>Mail me</form></article><div class='comments'><p>Nice!</p></div>"
        "<div id=cookie-notice>We use cookies</div><footer>&copy; Us</footer>"
    )
    rows = [(1, page), (2, None), (3, ""), (4, "<article><p>" + "word " * 50_000), (5, "plain"), (6, "<p>cut <"), (1, page)]
    df = spark.createDataFrame(rows, "page_id bigint, html string").withColumn("main_text", F.lit("old"))
    got = sorted((r.page_id, r.main_text) for r in html_extract.extract_main_text(df).collect())
    assert got[0] == got[1] == (1, "A & B\n\nOne two three\n\nFour five\n\nitem")
    assert got[2][1] == "" and got[3][1] == "" and len(got[4][1]) == 249_999
    assert html_extract.extract_main_text(df.limit(0)).collect() == []


def test_toxicity_odd_inputs(spark, odd_docs, make_docs):
    labels = spark.createDataFrame([(3, 1), (7, 0), (2, None), (None, 1)], "doc_id bigint, toxic int")
    model = toxicity.train(odd_docs, labels)
    out = toxicity.score_toxicity(odd_docs.withColumn("toxicity", F.lit(9)), model).collect()
    assert len(out) == 10 and all(0 <= r.toxicity <= 1 for r in out)
    empty = toxicity.train(odd_docs.limit(0), labels.limit(0))
    assert len({r.toxicity for r in toxicity.score_toxicity(odd_docs, empty).collect()}) == 1


def test_deobfuscation(spark, sf):
    counts = toxicity.letter_counts(
        spark.createDataFrame([("the idiot and the moron are a worthless clown or loser here",)] * 50, "text string")
    )
    model = toxicity.language_model(counts)
    for written, meant in {"1d10t": "idiot", "m0r0n": "moron", "l.o.s.e.r": "loser", "cloooown": "clown", "id!ot!!": "idiot"}.items():
        assert meant in toxicity.plain_words(written, model)
    read = toxicity.Reader(model)
    assert "wmoron" in read("he is a m o r o n")
    assert toxicity.plain_words("plain,", model) == ("plain",)


def test_secret_names_and_constants():
    text = 'base = "abcDEF123456xyz"\nDB_PASSWORD = base + "Zq9!zz"\nname = "nothing here"\n"private_key": "k3yk3yk3yQQ"\n'
    spans = secret_scan.literal_spans(text, text.encode())
    assert {text[a:b] for _, a, b in spans} >= {"abcDEF123456xyz", "k3yk3yk3yQQ"}
    assert secret_scan.scan(None) == ([], []) and secret_scan.scan("") == ([], [])
    assert secret_scan.scan('password = "changeme"')[1] == secret_scan.scan('password = "changeme"')[0]
    # no case folding beyond ASCII
    assert secret_scan.scan("to\u212aen = abcdefgh")[0] == []


def test_every_sensitive_name_is_scanned():
    value = "Xk29fLq81z"
    names = [n for n, s in secret_scan.NAME_SCORES.items() if s >= secret_scan.THRESHOLD]
    lines = [f'{n} = "{value}"' for n in [*names, "dbPass", "api_access", "sec_ret"]]
    for line in [*lines, f"pass: {value}", f'SMTP-PASS="{value}"', f'db.pass="{value}"']:
        assert [line[a:b] for _, a, b in secret_scan.literal_spans(line, line.encode())] == [value], line
    values = [f"Xk29fLq{i}z" for i in range(10, 60)]
    for many in ("db_pass = " + " + ".join(f'"{v}"' for v in values), "\n".join(f'db_pass += "{v}"' for v in values)):
        assert {many[a:b] for _, a, b in secret_scan.literal_spans(many, many.encode())} == set(values)


def test_wider_targets():
    value = "Xk29fLq81z"
    for line in (
        f'cfg["secret"] = "{value}"', f"os.environ['DB_PASSWORD'] = '{value}'", f'const t: string = "{value}"\nauthToken = t',
        f'let password: Optional[str] = "{value}"', f'set("password", "{value}")', f'x = "{value}"\nconf["api"]["secret"] = x',
    ):
        assert value in {line[a:b] for _, a, b in secret_scan.literal_spans(line, line.encode())}, line
    for line in (f'set("colour", "{value}")', f'cfg["size"] = "{value}"', f'const t: secret = 5\nname = "{value}"'):
        assert secret_scan.literal_spans(line, line.encode()) == [], line


def test_constants_keep_what_they_had():
    text = 'k = "Xk29fLq81a"\nmy_secret = k\nk += "Xk29fLq81b"\nk = "Xk29fLq81c"\nother_token = k + "Xk29fLq81d"\nname = k\n'
    found = {text[a:b] for _, a, b in secret_scan.literal_spans(text, text.encode())}
    assert found == {"Xk29fLq81a", "Xk29fLq81c", "Xk29fLq81d"}


def test_many_constants_take_time_in_proportion():
    import time

    for tail in ("y{} = k", "db_token{} = k"):
        text = "\n".join(f'k += "Xk29fLq{i:06d}"' for i in range(4000)) + "\n" + "\n".join(tail.format(i) for i in range(4000))
        start = time.perf_counter()
        found = secret_scan.literal_spans(text, text.encode())
        assert time.perf_counter() - start < 3
        assert len(found) == (4000 if "token" in tail else 0)


def test_secret_scan_rows(spark, odd_docs):
    out = secret_scan.scan_secrets(odd_docs.withColumn("spans", F.lit(1))).collect()
    assert len(out) == 10 and all(r.spans == "" for r in out)
    assert secret_scan.scan_secrets(odd_docs.limit(0)).collect() == []


def test_line_dedup(spark, make_docs, odd_docs):
    line = "This very line is longer than forty characters."
    rows = [(i, f"{line}\nown {i}\n  {line.upper()}\t") for i in range(5)] + [(9, None), (10, ""), (None, line)]
    got = {r.doc_id: r for r in line_dedup.drop_shared_lines(make_docs(rows).withColumn("kept", F.lit(1))).collect()}
    assert all(got[i].kept == f"own {i}" and got[i].n_dropped == 2 and got[i].n_lines == 3 for i in range(4))
    assert got[4].n_dropped == 0 and got[4].kept == rows[4][1]
    assert got[9].kept == got[10].kept == "" and got[9].n_lines == 1 and got[None].kept == line
    # four documents, one of them twice, are not five
    few = line_dedup.drop_shared_lines(make_docs(rows[:4] + rows[:1])).collect()
    assert len(few) == 5 and all(r.n_dropped == 0 for r in few)
    assert len(line_dedup.drop_shared_lines(odd_docs).collect()) == 10
    assert line_dedup.drop_shared_lines(odd_docs.limit(0)).collect() == []


@pytest.mark.parametrize("weights", [None, {"a": 0.5, "b": 0.3, None: 0.2}])
def test_mixture_stays_on_target(spark, make_docs, weights):
    rows = [(i, "t", "a") for i in range(300)] + [(1000 + i, "t", "b") for i in range(40)] + [(2000 + i, "t", None) for i in range(25)]
    docs = make_docs(rows).withColumn("mix_slot", F.lit("old"))
    out = mixing.mix_sources(docs, weights, block_rows=4, shares=64)
    got = out.collect()
    assert {r.doc_id for r in got} == {r[0] for r in rows}
    slots = {r.mix_slot: r.source for r in got}
    share = {r.s: r.p for r in mixing.target_shares(docs, weights, 64).select(
        F.explode(F.arrays_zip("names", "parts", F.array_repeat("total", F.size("names")))).alias("x")
    ).select(F.col("x.names").alias("s"), (F.col("x.parts") / F.col("x.2")).alias("p")).collect()}
    seen = dict.fromkeys(share, 0)
    for t in range(len(slots)):
        seen[slots[t] if slots[t] is not None else "\x00none"] += 1
        assert all(abs(n - share[s] * (t + 1)) < 1 for s, n in seen.items())


def test_columns_of_helper_names_pass_through(spark, make_docs, odd_docs):
    extra = ["slot", "total", "release", "deadline", "part", "block"]
    docs = odd_docs.selectExpr("*", *[f"'{c}' AS {c}" for c in extra])
    out = mixing.mix_sources(docs)
    assert out.columns[: len(docs.columns)] == docs.columns
    assert {tuple(r[c] for c in extra) for r in out.collect()} == {tuple(extra)}
    twice = sketches.with_next(make_docs([(1, "a"), (2, "b")]).selectExpr("*", "'x' AS next_text"), "doc_id", ["text"])
    assert sorted((r.doc_id, r.next_text) for r in twice.collect()) == [(1, "b"), (2, "a")] and twice.columns.count("next_text") == 1


def test_mixture_odd_inputs(odd_docs):
    assert len({(r.doc_id, r.text) for r in mixing.mix_sources(odd_docs).collect()}) == 9
    assert mixing.mix_sources(odd_docs.limit(0)).collect() == []


def test_shards_odd_inputs(odd_docs):
    got = sharding.stratified_shards(odd_docs.withColumn("shard", F.lit("old")), 3).collect()
    assert sorted((r.shard, r.slot) for r in got) == [(0, 0), (0, 1), (0, 2), (0, 3), (1, 0), (1, 1), (1, 2), (2, 0), (2, 1), (2, 2)]
    assert sharding.stratified_shards(odd_docs.limit(0)).collect() == []


def test_shards_in_many_buckets(spark, make_docs, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 7)
    rows = [(i, "t", "a" if i % 3 else f"s{i % 5}") for i in range(211)]
    got = sharding.stratified_shards(make_docs(rows), 4).collect()
    for s in range(4):
        at = [r for r in got if r.shard == s]
        assert sorted(r.slot for r in at) == list(range(len(at))) and 52 <= len(at) <= 53


def test_containment_both_ways(spark, make_docs, odd_docs):
    rng = np.random.default_rng(1)
    words = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 5000, n))
    items = [(i, words(n)) for i, n in enumerate([4, 8, 20, 60, 200])] + [(8, None), (9, ""), (None, words(9))]
    docs = [(i, words(3000) + " " + (t or "") + " " + words(2000)) for i, t in items if i is not None]
    half = items[3][1].split()
    docs += [(50, words(100) + " " + " ".join(half[:55]) + " " + words(100)), (51, words(100) + " " + " ".join(half[:20])), (52, items[0][1])]
    table = spark.createDataFrame(items, "item_id bigint, text string")
    want = {(i, i) for i in (0, 1, 2, 3, 4)} | {(50, 3), (52, 0)}
    for limit in (D.BROADCAST_ITEMS, 0):
        got = D.contained_items(make_docs(docs), table, broadcast_items=limit).collect()
        assert {(r.doc_id, r.item_id) for r in got} == want
    assert D.contained_items(odd_docs, table).collect() == []
    assert D.contained_items(odd_docs, table.limit(0)).collect() == []
    assert D.contained_items(odd_docs.limit(0), table).collect() == []


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (-9, 200)]
    got = {r.node: r.root for r in smallest_reachable(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 200: -9, -9: -9}
    assert smallest_reachable(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


@pytest.mark.parametrize("distance", [0, 1, 2])
@pytest.mark.parametrize("limit", [1, 64])
def test_links_are_complete(spark, monkeypatch, distance, limit):
    monkeypatch.setattr(simhash, "BUCKET_PAIRS", limit)
    rng = np.random.default_rng(distance)
    base = [int(x) for x in rng.integers(-(2**63), 2**63, 30)]
    near = [b ^ (1 << int(i)) ^ (1 << int(j)) for b in base for i, j in rng.integers(0, 63, (6, 2))]
    prints = sorted({*base, *near})
    df = spark.createDataFrame([(p,) for p in prints], "__fp bigint")
    got = {r.node: r.root for r in smallest_reachable(simhash.linked_prints(df, distance)).collect()}
    root = {p: p for p in prints}
    for _ in range(12):
        for a in prints:
            for b in prints:
                if ((a ^ b) & (2**64 - 1)).bit_count() <= distance:
                    root[a] = root[b] = min(root[a], root[b])
    assert {p: got.get(p, p) for p in prints} == root


def test_thresholds_follow_the_pigeonhole(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 2, (500, 64)).astype(float)
    x[:, 1] = x[:, 0]
    plan = simhash.plan_partitions(x.T @ x, 500, 2)
    assert sum(p.threshold + 1 for p in plan) >= 3
    groups = simhash.correlated_groups(x.T @ x, 500, 3)
    assert sorted(b for g in groups for b in g) == list(range(64)) and any({0, 1} <= set(g) for g in groups)


def test_simhash_odd_inputs(odd_docs):
    got = simhash.near_duplicates(odd_docs.withColumn("fingerprint", F.lit(1))).collect()
    assert len(got) == 10
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[1].fingerprint == by[2].fingerprint == "0" * 16 and by[2].component_id == 1 and by[7].component_id == 3
    assert simhash.near_duplicates(odd_docs.limit(0)).collect() == []


def test_near_groups(spark, make_docs, odd_docs):
    rng = np.random.default_rng(5)
    text = [f"w{x}" for x in rng.integers(0, 3000, 400)]
    changed = list(text)
    for i in rng.integers(0, 400, 4):
        changed[i] = "other"
    other = [f"w{x}" for x in rng.integers(0, 3000, 400)]
    rows = [(5, " ".join(text)), (6, " ".join(changed)), (8, " ".join(other)), (9, " ".join(text).upper())]
    got = {r.doc_id: r.component_id for r in simhash.near_groups(make_docs(rows)).collect()}
    assert got == {5: 5, 6: 5, 8: 8, 9: 5}
    assert simhash.near_groups(odd_docs.limit(0)).collect() == []
    assert len(simhash.near_groups(odd_docs).collect()) == 8


def edited_blocks(rng, lowest, highest, n, ids=0):
    """Texts of 150 to 600 words and near copies with a block appended, cut off or
    replaced, whose resemblance is within the limits: rows ``id, text``, ids 2 i
    and 2 i + 1 of a pair, and the resemblance of each pair."""
    rows, likeness = [], []
    for i in range(n):
        size = int(rng.integers(150, 600))
        text = [f"w{x}" for x in rng.integers(0, 5000, size)]
        s = rng.uniform(lowest, highest)
        if i % 3 == 2:  # a replaced block changes both texts
            k = max(1, int((1 - s) / (1 + s) * size) - 4)
            at = int(rng.integers(0, size - k))
            other = text[:at] + [f"x{i}y{j}" for j in range(k)] + text[at + k :]
        else:
            other = text[: int(s * (size - 4)) + 5]
        a, b = ({tuple(t[j : j + 5]) for j in range(len(t) - 4)} for t in (text, other))
        likeness.append(len(a & b) / len(a | b))
        rows += [(ids + 2 * i, " ".join(text)), (ids + 2 * i + 1, " ".join(other))]
    return rows, likeness


def test_groups_are_not_below_the_limit(spark, make_docs):
    rows, likeness = edited_blocks(np.random.default_rng(8), 0.74, 0.79, 60)
    assert min(likeness) > 0.7 and max(likeness) < 0.8
    assert all(r.doc_id == r.component_id for r in simhash.near_groups(make_docs(rows)).collect())


def test_edited_blocks_are_found(spark, make_docs):
    rows, likeness = edited_blocks(np.random.default_rng(9), 0.81, 0.93, 150)
    got = {r.doc_id: r.component_id for r in simhash.near_groups(make_docs(rows)).collect()}
    assert min(likeness) >= 0.8 and max(likeness) < 0.95
    assert sum(got[2 * i] == got[2 * i + 1] for i in range(150)) >= 148


def test_no_pair_of_a_large_bucket_is_skipped(spark):
    # 150 members of one bucket; none resembles the smallest, and links join
    # members 40 apart
    rows = [(0, 7, i, 100, i + 1) for i in range(150)]
    members = spark.createDataFrame(rows, "part int, key bigint, node bigint, __size int, __rank int")
    roots = simhash.linked_members(members, 0.8, lambda pairs: pairs.where("a > 0 AND b > 0 AND abs(a - b) = 40"))
    assert {(r.node, r.root) for r in roots.collect()} == {(i, (i - 1) % 40 + 1) for i in range(1, 150)}


def test_short_and_repeated_items(spark, make_docs):
    filler = " ".join(f"f{i}" for i in range(3000))
    items = [(1, "alpha"), (2, "Beta gamma"), (3, "one two three"), (3, "red green blue cyan"), (None, "lost item"), (5, "alpha beta"), (6, "!?"), (7, "f1 f2 f3 f4 f5 f6")]
    table = spark.createDataFrame(items, "item_id bigint, text string")
    docs = [(1, filler + " ALPHA. " + filler), (2, "x beta, Gamma y"), (3, filler + " one two three"), (4, "red green blue cyan"), (5, "a lost item here"), (6, "beta alpha"), (7, None), (8, "one two")]
    want = {(1, 1), (1, 7), (2, 2), (3, 3), (3, 7), (4, 3), (5, None), (6, 1)}
    for limit in (D.BROADCAST_ITEMS, 0):
        got = D.contained_items(make_docs(docs), table, broadcast_items=limit).collect()
        assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
        assert all(r.containment == r.n_shared / r.n_item == 1.0 for r in got)


def test_urls(spark):
    urls = [None, "", "no scheme", "HTTP://Www.A.com:80/x/index.html?utm_source=1&b=2&a=1#f", "https://a.com/x?a=1&b=2", "x://", "s://h?q", "s://h#f", "://b/c"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id bigint, url string").withColumn("rule", F.lit(1))
    listed = spark.createDataFrame([("http://a.com/x?b=2&a=1",), (None,), ("",)], "url string")
    got = {r.page_id: r for r in url_filter.judge_urls(df, listed, [("allow", "b", "/")]).collect()}
    assert len(got) == 9
    assert [got[i].listed for i in range(9)] == [False, False, False, True, True, False, False, False, False]
    assert (got[3].host, got[3].path) == ("www.a.com:80", "/x/index.html") and got[3].verdict == "block"
    assert (got[6].host, got[6].path, got[7].host) == ("h", "", "h") and got[8].rule == "b/" and got[8].host == "b"
    assert (got[0].host, got[0].path, got[0].rule, got[0].verdict) == ("", "", None, "allow")
    assert url_filter.judge_urls(df.limit(0), listed.limit(0)).collect() == []


def test_only_possible_hits_are_dealt_by_url(spark):
    rows = spark.range(3000).selectExpr("id AS page_id", "IF(id % 10 < 9, NULL, concat('http://h/', id % 40)) AS url")
    listed = spark.createDataFrame([("http://h/9",), ("http://h/19",)], "url string")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = url_filter.judge_urls(rows, listed).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert len(got) == 3000 and sorted(r.page_id for r in got) == list(range(3000))
    assert all(r.listed == (r.url in ("http://h/9", "http://h/19")) for r in got)


def test_bloom_words_merge(spark):
    df = spark.createDataFrame([(f"http://h/{i}",) for i in range(200)], "url string")
    table, words = url_filter.blocked_bloom(df)
    assert table.count() <= words
    other = spark.createDataFrame([(f"http://h/no{i}",) for i in range(1000)], "url string")
    assert url_filter.listed_urls(other, df).where("listed").count() == 0
    assert url_filter.listed_urls(df, df).where("listed").count() == 200


def test_native_plans(spark, sf):
    from bitexture.llm.queries import QUERIES

    for name in ("op1_fingerprints", "op6_mix_sources", "op10_url_filter"):
        plan = QUERIES[name].run(spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)


@pytest.mark.parametrize("number", range(len(STAGES)))
def test_stages_on_odd_inputs(spark, odd_docs, tmp_path, number):
    spark.createDataFrame([(3, 1, 1), (7, 1, 0), (None, 0, 1)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "a b c d e f g h"), (2, None)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stage = STAGES[number][1]
    for docs in (odd_docs, odd_docs.limit(0)):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns[:5] == docs.columns
        assert number == len(STAGES) - 1 or out.columns == docs.columns
        ids = {r.doc_id for r in out.collect()}
        assert ids <= {r.doc_id for r in docs.collect()}
        if STAGES[number][0].startswith(("mixing", "sharding")):
            assert ids == {r.doc_id for r in docs.collect()}
