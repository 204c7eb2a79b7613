"""Requests over a small memory, and streams over files."""

import datetime as dt
import random

from pyspark.sql import functions as F

from bitexture.functions.text import NO_TRANSLATION
from bitexture.operators.requests import process_requests, resolve_same_language, swap_languages, translate_batch
from bitexture.streaming.jobs import debounce, debounce_stream, stream_requests, write_available

EN, VI, JA = "Tiếng Anh", "Tiếng Việt", "Tiếng Nhật"
MEMORY = [
    (EN, VI, "Hello.", "Xin chào ."),
    (EN, VI, "I am here!", "Tôi & quot ; đây & quot ; !"),
    (EN, JA, "Hello.", "Kon"),
    (VI, EN, "Chào.", "Hello."),
    (EN, VI, "Nothing.", " "),
]


def memory(spark):
    return spark.createDataFrame(MEMORY, "src_lang string, tgt_lang string, src string, tgt string")


def test_process_requests(spark):
    cases = [
        (1, " hello. i am here! ", EN, VI),
        (2, "Hello.\nUnknown sentence. Hello.", EN, VI),
        (3, "Chào.", VI, JA),
        (4, "  ", EN, VI),
        (5, "x", EN, EN),
        (6, "Nothing.", EN, VI),
        (7, "x", "Latin", VI),
    ]
    df = spark.createDataFrame(cases, "req_id int, source_text string, source_lang string, target_lang string")
    got = {r.req_id: (r.status, r.pivot, r.model, r.translated_text) for r in process_requests(df, memory(spark)).collect()}
    ok = "Transformer"
    assert got[1] == (200, False, ok, 'Xin chào. Tôi" đây"!')
    assert got[2] == (200, False, ok, "Xin chào. Xin chào.")
    assert got[3] == (200, True, ok, "Kon")
    assert got[4] == (400, False, None, None) and got[5][0] == 400 and got[7][0] == 400
    assert got[6] == (200, False, ok, NO_TRANSLATION)


def test_form_helpers(spark):
    df = spark.createDataFrame([(EN, EN), (VI, VI), (VI, JA)], "source_lang string, target_lang string")
    assert [r.target_lang for r in resolve_same_language(df, [EN, VI, JA]).collect()] == [VI, EN, JA]
    rows = spark.createDataFrame(
        [("a", EN, VI, "b", True), ("a", EN, VI, "err", False), ("", EN, VI, "b", True)],
        "source_text string, source_lang string, target_lang string, output_text string, output_ok boolean",
    )
    got = [(r.source_text, r.source_lang, r.target_lang) for r in swap_languages(rows).collect()]
    assert got == [("b", VI, EN), ("a", VI, EN), ("", VI, EN)]


def test_translate_batch_builds_once_per_stream(spark):
    def make():
        calls = []

        def translate(text):
            calls.append(text)
            return f"{text}:{len(calls)}"

        return translate

    df = spark.range(4).select(F.col("id").cast("string").alias("src")).coalesce(1)
    assert sorted(r.hyp for r in translate_batch(df, make).collect()) == ["0:1", "1:2", "2:3", "3:4"]


def test_stream_equals_batch(spark, tmp_path):
    cases = [(i, [" hello", ""][i % 2], [EN, VI, "??"][i % 3], [VI, JA][i % 2]) for i in range(30)]
    schema = "req_id int, source_text string, source_lang string, target_lang string"
    df = spark.createDataFrame(cases, schema)
    for part in (df.where("req_id < 10"), df.where("req_id >= 10")):
        part.write.mode("append").json(str(tmp_path / "in"))
        stream = stream_requests(spark.readStream.schema(schema).json(str(tmp_path / "in")))
        write_available(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = spark.read.schema(stream.schema).parquet(str(tmp_path / "out"))
    want = stream_requests(df)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def python_bursts(rows, gap):
    out = []
    for user in {r[0] for r in rows}:
        times = sorted((t, v) for u, t, v in rows if u == user)
        burst = [times[0]]
        for item in times[1:] + [None]:
            if item is None or item[0] - burst[-1][0] > gap:
                out.append((user, burst[0][0], burst[-1][0] + gap, len(burst), burst[-1][1]))
                burst = []
            if item is not None:
                burst.append(item)
    return sorted(out)


def test_debounce_across_blocks(spark):
    rng = random.Random(6)
    gap = 500_000
    # a hot user typing without pause over many blocks, and quiet ones
    rows = [(0, i * 300_000 + 7, f"h{i}") for i in range(200)]
    rows += [(u, t, f"{u}-{t}") for u in (1, 2, 3) for t in rng.sample(range(1, 60_000_000, 1999), 150)]
    df = spark.createDataFrame(rows, "user_id int, us bigint, text string").select(
        "user_id", F.timestamp_micros("us").alias("ts"), "text"
    )
    for partitions in ("1", "3", "40"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            out = debounce(df.repartition(5), gap).select("user_id", F.unix_micros("first_at"), F.unix_micros("fires_at"), "n_inputs", "text")
            assert sorted(map(tuple, out.collect())) == python_bursts(rows, gap), partitions
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_debounce_odd_rows(spark):
    # equal inputs of one user, NULL users and times, ties at one time
    rows = [(1, 5_000_000, "x")] * 300 + [(None, 7, "n"), (None, 9, "m"), (2, None, "t"), (3, 1, "a"), (3, 1, "b"), (3, 1, None)]
    df = spark.createDataFrame(rows, "user_id int, us bigint, text string").repartition(7)
    out = debounce(df.select("user_id", F.timestamp_micros("us").alias("ts"), "text"))
    assert sorted((r.user_id or 0, r.n_inputs, r.text) for r in out.collect()) == [(0, 2, "m"), (1, 300, "x"), (3, 3, "b")]
    assert debounce(df.limit(0).select("user_id", F.timestamp_micros("us").alias("ts"), "text")).collect() == []


def test_one_user_is_spread_over_all_tasks(spark):
    df = spark.range(40_000).select(F.lit("u").alias("user_id"), F.timestamp_micros(F.col("id") * 1000).alias("ts"), F.col("id").cast("string").alias("text"))
    out = debounce(df, 10)
    sizes = sorted(r.n_inputs for r in out.collect())
    assert sizes == [1] * 40_000
    assert [(r.n_inputs, r.text) for r in debounce(df, 2_000).collect()] == [(40_000, "39999")]


def test_debounce_stream_closes_bursts(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    rows = [(1, base + dt.timedelta(milliseconds=ms), f"t{ms}") for ms in (0, 300, 700, 5000, 5100)]
    rows.append((2, base + dt.timedelta(hours=1), "late"))
    schema = "user_id int, ts timestamp, text string"
    spark.createDataFrame(rows, schema).write.json(str(tmp_path / "in"))
    stream = debounce_stream(spark.readStream.schema(schema).json(str(tmp_path / "in")), late="1 second")
    write_available(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = spark.read.schema(stream.schema).parquet(str(tmp_path / "out")).orderBy("first_at").collect()
    assert [(r.user_id, r.n_inputs, r.text) for r in got] == [(1, 3, "t700"), (1, 2, "t5100")]
