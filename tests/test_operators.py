"""Operators against brute force, under skew and several partitionings."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from bitexture.operators import corpus as C
from bitexture.operators import lookup as J
from bitexture.operators import ranks as R
from bitexture.operators import runs as U
from bitexture.operators import shuffle as S


@pytest.fixture(params=[1, 7])
def partitions(spark, request):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(request.param))
    yield request.param
    spark.conf.set("spark.sql.shuffle.partitions", old)


def md5(*parts):
    return hashlib.md5(":".join(str(p) for p in parts).encode()).hexdigest()


def skewed(n=900):
    """(key, order, value): a third of the rows has one key; order is sparse."""
    rng = random.Random(1)
    orders = rng.sample(range(0, 2**36, 17), n)
    return [("hot" if rng.random() < 0.34 else f"k{rng.randrange(5)}", o, rng.randrange(10)) for o in orders]


def test_running_sums(spark, partitions):
    rows = skewed()
    df = spark.createDataFrame(rows, "k string, o bigint, v bigint").repartition(5)
    out = R.running_sums(df, ["k"], ["o"], R.integer_levels("o"), {"n": F.lit(1).cast("bigint"), "s": F.col("v")})
    want, n, s = {}, {}, {}
    for k, o, v in sorted(rows, key=lambda r: r[1]):
        n[k], s[k] = n.get(k, 0) + 1, s.get(k, 0) + v
        want[(k, o)] = (n[k], s[k])
    got = {(r.k, r.o): (r.n, r.s) for r in out.collect()}
    assert got == want


def test_rank_cuts(spark, partitions):
    rows = skewed()
    df = spark.createDataFrame(rows, "k string, o bigint, v bigint").repartition(5)
    cuts = R.rank_cuts(df, ["k"], ["o"], R.integer_levels("o"), F.array(F.lit(1), F.lit(40), F.lit(200)), F.col("v") > 2)
    got = {(r.k, r.target): (r.cut.o, r.total) for r in cuts.collect()}
    want = {}
    for k in {r[0] for r in rows}:
        orders = sorted(o for kk, o, v in rows if kk == k and v > 2)
        for t in (1, 40, 200):
            if t <= len(orders):
                want[(k, t)] = (orders[t - 1], len(orders))
    assert got == want and len(want) > 8


def test_shuffle_and_batches(spark, partitions):
    df = spark.range(1000).withColumnRenamed("id", "line_no").repartition(3)
    order = sorted(range(1000), key=lambda i: (md5("42", i), i))
    rows = S.assign_batches(S.shuffled_index(df, ["line_no"]), size=64).collect()
    assert {r.line_no: r.row_idx for r in rows} == {v: i for i, v in enumerate(order)}
    assert all(r.batch_id == r.row_idx // 64 for r in rows)
    assert [r.line_no for r in S.seeded_shuffle(df, ["line_no"]).collect()] == order
    later = [r.line_no for r in S.epoch_shuffle(df, ["line_no"], 2).collect()]
    assert sorted(later) == list(range(1000)) and later != order


@pytest.mark.parametrize("ratios", [(0.85, 0.10, 0.05), (0.0005, 0.9, 0.0995), (0.5, 0.0, 0.5), (1.0, 0.0, 0.0)])
def test_split_exact(spark, partitions, ratios):
    n = 1003
    df = spark.range(n).withColumnRenamed("id", "line_no").repartition(3)
    order = sorted(range(n), key=lambda i: (md5("42", i), i))
    a = int(n * ratios[0])
    b = a + int(n * ratios[1])
    want = {v: "train" if i < a else "val" if i < b else "test" for i, v in enumerate(order)}
    got = {r.line_no: r.split for r in S.split_exact(df, ["line_no"], ratios).collect()}
    assert got == want


def test_split_groups_stay_together(spark):
    df = spark.range(600).select((F.col("id") % 200).alias("pair"), "id")
    for out in (S.split_exact(df, ["id"], group=["pair"]), S.split_hash(df, ["id"], group=["pair"])):
        assert out.groupBy("pair").agg(F.countDistinct("split").alias("n")).where("n > 1").isEmpty()
    sizes = {r.split: r["count"] for r in S.split_exact(df, ["id"], group=["pair"]).groupBy("split").count().collect()}
    assert sizes == {"train": 510, "val": 60, "test": 30}


def test_split_ratios_checked(spark):
    with pytest.raises(ValueError):
        S.split_exact(spark.range(3), ["id"], (0.5, 0.4, 0.2))


def pair_rows():
    rng = random.Random(3)
    rows = []
    for i in range(600):
        lang = "ja" if rng.random() < 0.7 else "vi"
        src = rng.choice(["good \u201csource\u201d", "#bad", "x", "also\tgood  one", "e\u0301e\u0301e\u0301"])
        rows.append((lang, i * 70_001, src, rng.choice(["target", "t", "\u200b"])))
    return rows


CLEANED = {
    'good \u201csource\u201d': 'good "source"',
    '#bad': '#bad',
    'x': 'x',
    'also\tgood  one': 'also good one',
    'e\u0301e\u0301e\u0301': '\xe9\xe9\xe9',
    'target': 'target',
    't': 't',
    '\u200b': '',
}


def python_load(rows, cap):
    """Per language: read rows in order until the cap is reached."""
    kept, stats = [], {}
    for lang, line, src, tgt in sorted(rows, key=lambda r: r[1]):
        raw, ok, skip = stats.get(lang, (0, 0, 0))
        if ok >= cap:
            continue
        s, t = CLEANED[src], CLEANED[tgt]
        good = 3 <= len(s) <= 500 and 3 <= len(t) <= 500 and s[0] != "#" and t[0] != "#"
        stats[lang] = (raw + 1, ok + good, skip + (not good))
        if good:
            kept.append((lang, line, s, t))
    return kept, stats


@pytest.mark.parametrize("cap", [1, 50, 10_000])
def test_cap_and_load_stats(spark, partitions, cap):
    rows = pair_rows()
    df = spark.createDataFrame(rows, "lang string, line_no bigint, src string, tgt string").repartition(6)
    kept, stats = python_load(rows, cap)
    assert sorted(map(tuple, C.cap_per_language(df, cap).select("lang", "line_no", "src", "tgt").collect())) == sorted(kept)
    assert {r.lang: (r.raw, r.valid, r.skipped) for r in C.load_stats(df, cap).collect()} == stats


def test_cap_zero(spark):
    df = spark.createDataFrame(pair_rows(), "lang string, line_no bigint, src string, tgt string")
    assert C.cap_per_language(df, 0).isEmpty() and C.load_stats(df, 0).isEmpty()


def test_both_directions_doubles(spark):
    df = spark.createDataFrame([("ja", 1, "a\tb", "c")], "lang string, line_no bigint, src string, tgt string")
    rows = sorted((r.src, r.tgt) for r in C.both_directions(df).collect())
    assert rows == [("<2en> c", "a b"), ("<2ja> a b", "c")]


@pytest.mark.parametrize("how", ["left", "inner"])
def test_lookup_join_salts_hot_keys(spark, how):
    left = [(i, "hot" if i % 3 == 0 else f"k{i % 40}") for i in range(900)]
    right = [("hot", "H")] + [(f"k{i}", str(i)) for i in range(0, 40, 2)]
    l = spark.createDataFrame(left, "id int, key string")
    r = spark.createDataFrame(right, "key string, value string")
    out = J.lookup_join(l, r, ["key"], how, spread=["id"], min_rows=100)
    table = dict(right)
    want = [(k, i, table.get(k)) for i, k in left if how == "left" or k in table]
    assert sorted(((x.key, x.id, x.value) for x in out.collect()), key=str) == sorted(want, key=str)


def test_pivot_pairs(spark):
    to_en = spark.createDataFrame(
        [("vi", "xin", "hello"), ("vi", "xin", "zzz"), ("ja", "kon", "hello "), ("vi", "khong", "none")],
        "src_lang string, text string, english string",
    )
    from_en = spark.createDataFrame(
        [("ja", "hello", "kon"), ("vi", "hello", "xin"), ("vi", "hello", "chao"), ("zh", "hello", "ni")],
        "tgt_lang string, english string, translation string",
    )
    got = sorted((r.src_lang, r.text, r.tgt_lang, r.translation) for r in C.pivot_pairs(to_en, from_en).collect())
    assert got == [
        ("ja", "kon", "vi", "chao"),
        ("ja", "kon", "zh", "ni"),
        ("vi", "xin", "ja", "kon"),
        ("vi", "xin", "zh", "ni"),
    ]


def test_early_stop_is_the_training_loop(spark):
    rng = random.Random(5)
    rows = [(f"r{r}", e, round(rng.random() + 1 / e, 2)) for r in range(12) for e in range(1, 31)]
    df = spark.createDataFrame(rows, "run_id string, epoch int, val double")
    for patience in (1, 3, 5):
        want = {}
        for run in {r[0] for r in rows}:
            best, wait = float("inf"), 0
            for _, e, v in sorted(r for r in rows if r[0] == run):
                if v < best:
                    best, wait = v, 0
                else:
                    wait += 1
                want[(run, e)] = (wait, wait >= patience)
                if wait >= patience:
                    break
        got = {(r.run_id, r.epoch): (r.no_improve, r.stopped) for r in U.early_stop(df, patience).collect()}
        assert got == want


def test_epoch_loss_modes(spark):
    df = spark.createDataFrame([(1, 2.0, 10), (1, 4.0, 30), (2, None, 0)], "epoch int, loss double, n_tokens int")
    assert {r.epoch: r.loss for r in U.epoch_loss(df, ["epoch"]).collect()} == {1: 3.0, 2: float("inf")}
    token = {r.epoch: r.loss for r in U.epoch_loss(df.where("epoch = 1"), ["epoch"], "token").collect()}
    assert token == {1: 3.5}


def test_last_and_best_k(spark):
    names = [f"transformer_ep{i}.pt" for i in (1, 2, 9, 10, 11)]
    df = spark.createDataFrame([(n, int(n[14:-3]), 1.0 / int(n[14:-3])) for n in names], "name string, epoch int, val_loss double")
    assert [r.epoch for r in U.last_k_artifacts(df, 2, "name").collect()] == [9, 2]
    assert [r.epoch for r in U.last_k_artifacts(df, 2, "epoch").collect()] == [11, 10]
    assert [r.epoch for r in U.best_k_artifacts(df, 1).collect()] == [11]


def test_sparse_ids_stay_in_small_buckets(spark):
    from bitexture.operators.ranks import integer_levels

    rng = random.Random(4)
    ids = sorted({rng.randrange(-(2**62), 2**62) for _ in range(3000)})
    df = spark.createDataFrame([(i,) for i in ids], "n bigint").withColumn("k", F.lit(1))
    got = S.file_order_index(df, "n").orderBy("n").collect()
    assert [r.row_idx for r in got] == list(range(len(ids)))
    coarse = df.select(integer_levels("n")[0].alias("b")).agg(F.min("b"), F.max("b")).first()
    assert -(2**15) <= coarse[0] and coarse[1] < 2**15


def test_cap_by_a_callers_rule(spark):
    rows = [(i, "de" if i % 3 else "fr", f" s{i} " if i % 4 else "  ", "#t") for i in range(400)]
    df = spark.createDataFrame(rows, "line_no bigint, lang string, src string, tgt string").repartition(5)
    got = C.cap_per_language(df, 20, C.stripped_pairs, C.non_empty()).collect()
    want = []
    for lang in ("de", "fr"):
        want += [(n, lang, s.strip(), t) for n, k, s, t in rows if k == lang and s.strip()][:20]
    assert sorted(map(tuple, got)) == sorted(want)


def test_cap_where_valid_lines_come_late(spark):
    """The first prefix holds no valid pair, and lines are far apart."""
    rows = [(n * n * 1000, "de", "x" if n < 900 else f"long {n}", "target") for n in range(1000)]
    rows += [(n, None, f"long {n}", "target") for n in range(30)]
    df = spark.createDataFrame(rows, "line_no bigint, lang string, src string, tgt string")
    got = C.cap_per_language(df, 10).collect()
    assert sorted((r.lang or "", r.line_no) for r in got) == [("", n) for n in range(10)] + [("de", n * n * 1000) for n in range(900, 910)]
    stats = {r.lang: (r.raw, r.valid, r.skipped) for r in C.load_stats(df, 10).collect()}
    assert stats == {"de": (910, 10, 900), None: (10, 10, 0)}


def test_cap_limits_reach_the_scan(spark, tmp_path):
    df = spark.range(1000).selectExpr("id AS line_no", "IF(id % 2 = 0, 'de', 'fr') AS lang", "'a' AS src", "'b' AS tgt")
    df.write.parquet(f"{tmp_path}/t")
    limited = spark.read.parquet(f"{tmp_path}/t").where(C._lines_between({"de": (3, 50), "fr": (-1, 70)}))
    plan = limited._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(" in plan and "LessThanOrEqual(line_no,50)" in plan
    assert limited.count() == 24 + 35


def test_average_blocks(spark, monkeypatch):
    from bitexture.operators import runs as R

    monkeypatch.setattr(R, "BLOCK_VALUES", 4)
    rng = random.Random(1)
    rows = [(c, n, [rng.random() for _ in range(size)]) for c in range(6) for n, size in (("a", 10), ("b", 4), ("c", 1), ("d", 0))]
    df = spark.createDataFrame(rows + [(9, "a", None)], "ckpt int, name string, values array<float>").repartition(4)
    got = {r.name: r["values"] for r in R.average_vectors(df).collect()}
    for name, size in (("a", 10), ("b", 4), ("c", 1), ("d", 0)):
        mine = [v for _, n, v in rows if n == name]
        assert len(got[name]) == size
        assert all(abs(x - sum(col) / 6) < 1e-6 for x, col in zip(got[name], zip(*mine)))
    sizes = [len(r["values"]) for r in R.average_blocks(df).where("name = 'a'").orderBy("block").collect()]
    assert sizes == [4, 4, 2]
    for odd in ([1.0] * 9, [None] * 10):
        more = df.unionByName(spark.createDataFrame([(7, "a", odd)], df.schema))
        with pytest.raises(Exception, match="values"):
            R.average_vectors(more).collect()
