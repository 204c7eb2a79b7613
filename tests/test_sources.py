"""Readers and writers on fresh temporary folders."""

import json

import pytest

from bitexture.plans.jobs import write_corpus
from bitexture.sources import artifacts as A
from bitexture.sources import records as R
from bitexture.sources import text as X


def lines_of(spark, path):
    return [r.value for r in spark.read.text(path).collect()]


def test_numbered_lines_over_many_blocks(spark, tmp_path):
    want = [f"line {i} " + "x" * (i % 37) for i in range(5000)]
    (tmp_path / "a.txt").write_text("\n".join(want) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096b")
    try:
        got = {r.line_no: r.value for r in X.read_numbered_lines(spark, str(tmp_path / "a.txt")).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == dict(enumerate(want))


def test_numbered_lines_over_files(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"part-{i}.txt").write_text(f"a{i}\n\nb{i}\n")
    rows = X.read_numbered_lines(spark, str(tmp_path)).orderBy("line_no").collect()
    assert [r.value for r in rows] == ["a0", "", "b0", "a1", "", "b1", "a2", "", "b2"]
    assert [r.line_no for r in rows] == list(range(9))


def test_parallel_text(spark, tmp_path):
    (tmp_path / "x.en").write_text("one\ntwo\nthree\n", encoding="utf-8")
    (tmp_path / "x.vi").write_text("một\nhai\n", encoding="utf-8")
    df = X.read_parallel_text(spark, str(tmp_path / "x.en"), str(tmp_path / "x.vi"))
    assert sorted(map(tuple, df.collect())) == [(0, "one", "một"), (1, "two", "hai")]
    assert X.read_parallel_text(spark, str(tmp_path / "x.en"), str(tmp_path / "no")).isEmpty()


def test_write_parallel_text_stays_aligned(spark, tmp_path):
    rows = [(i, f"s{i}\nmore", f"t{i}") for i in range(500)]
    df = spark.createDataFrame(rows, "line_no bigint, src string, tgt string").repartition(7)
    a, b = X.write_parallel_text(df, str(tmp_path / "out"), "en", "ja")
    assert a.endswith("train.en-ja.en") and b.endswith("train.en-ja.ja")
    back = X.read_parallel_text(spark, a, b).orderBy("line_no").collect()
    assert [(r.src, r.tgt) for r in back] == [(f"s{i} more", f"t{i}") for i in range(500)]
    with pytest.raises(ValueError):
        X.write_parallel_text(df, str(tmp_path / "bad"), newline_policy="drop")


def test_tagged_tsv(spark, tmp_path):
    text = "<2vi> a\tb\tc\n\n   \n<2vi> no tab\n<2vi> x\t \n 　<2ja> q\tr  \n\tonly target\n"
    (tmp_path / "t.txt").write_text(text, encoding="utf-8")
    pairs, stats = X.read_tagged_tsv(spark, str(tmp_path / "t.txt"))
    assert sorted(map(tuple, pairs.collect())) == [("<2ja> q", "r"), ("<2vi> a", "b\tc")]
    assert tuple(stats.head()) == (2, 3, 2)
    with pytest.raises(FileNotFoundError):
        X.read_tagged_tsv(spark, str(tmp_path / "none.txt"))


def test_write_tagged_tsv_policies(spark, tmp_path):
    df = spark.createDataFrame([("<2vi> a\tb\nc", "d\te")], "src string, tgt string")
    X.write_tagged_tsv(df, str(tmp_path / "space"))
    assert lines_of(spark, str(tmp_path / "space")) == ["<2vi> a b c\td e"]
    X.write_tagged_tsv(df, str(tmp_path / "keep"), "keep")
    assert sorted(lines_of(spark, str(tmp_path / "keep"))) == ["<2vi> a b", "c\td e"]


def test_reuse_or_split(spark, tmp_path):
    (tmp_path / "all.txt").write_text("".join(f"l{i}\n" if i % 5 else "  \n" for i in range(500)))
    source, folder = str(tmp_path / "all.txt"), str(tmp_path / "splits")
    paths, reused = X.reuse_or_split(spark, source, folder)
    assert not reused
    sizes = {s: spark.read.text(p).count() for s, p in paths.items()}
    assert sizes == {"train": 340, "val": 40, "test": 20}
    assert X.reuse_or_split(spark, source, folder)[1]
    assert not X.reuse_or_split(spark, source, folder, reuse=False)[1]
    values = sorted(v for p in paths.values() for v in lines_of(spark, p))
    assert values == sorted(f"l{i}" for i in range(500) if i % 5)
    with pytest.raises(FileNotFoundError):
        X.reuse_or_split(spark, str(tmp_path / "no.txt"), str(tmp_path / "s2"))
    (tmp_path / "blank.txt").write_text("\n \n")
    with pytest.raises(ValueError):
        X.reuse_or_split(spark, str(tmp_path / "blank.txt"), str(tmp_path / "s3"))


@pytest.mark.parametrize("kind", ["map<string,string>", "struct<en:string,ja:string>"])
def test_translations(spark, tmp_path, kind):
    rows = [({"en": "hello", "ja": "kon"},), ({"en": "only"},)]
    if kind.startswith("struct"):
        rows = [(("hello", "kon"),), (("only", None),)]
    spark.createDataFrame(rows, f"translation {kind}").write.parquet(str(tmp_path / "test"))
    df, path = R.read_first_available(spark, [str(tmp_path / "train"), str(tmp_path / "test")], "ja")
    assert path.endswith("test")
    assert sorted(map(tuple, df.drop("line_no").collect())) == [("ja", "hello", "kon"), ("ja", "only", "")]
    assert sorted(r.line_no for r in df.collect()) == [0, 1]
    zh = R.read_translations(spark, path, "zh")
    assert sorted(r.tgt for r in zh.collect()) == ["", ""]
    empty, none = R.read_first_available(spark, [str(tmp_path / "nope")], "ja")
    assert none is None and empty.isEmpty() and empty.columns == ["line_no", "lang", "src", "tgt"]


def test_run_history(spark, tmp_path):
    rows = [json.dumps({"epoch": 2, "val_loss": 1.5, "lr": 0.1}), "{broken", json.dumps({"epoch": 1, "val_loss": 2.0, "train_loss": 3.0})]
    (tmp_path / "h.json").write_text("\n".join(rows) + "\n")
    got = [tuple(r) for r in R.read_run_history(spark, str(tmp_path / "h.json")).collect()]
    assert got == [(1, 2.0, 3.0, 0.0), (2, 1.5, 0.0, 0.1)]


def test_manifest_and_artifacts(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"x" * 2_000_000)
    for n in ("transformer_ep02.pt", "transformer_ep11.pt", "transformer_epbest.pt"):
        (tmp_path / n).write_bytes(b"123")
    manifest = A.input_manifest(spark, {"model": str(tmp_path / "a.bin"), "vocab": str(tmp_path / "missing")})
    rows = {r.name: (r.present, r.mb) for r in manifest.collect()}
    assert rows == {"model": (True, 2.0), "vocab": (False, None)}
    assert A.all_present(manifest).head().all_ok is False
    files = A.list_artifacts(spark, str(tmp_path / "transformer_ep*.pt"))
    assert sorted(map(tuple, files.collect())) == [
        ("transformer_ep02.pt", 3, 2),
        ("transformer_ep11.pt", 3, 11),
        ("transformer_epbest.pt", 3, 0),
    ]
    assert A.list_artifacts(spark, str(tmp_path / "none*.pt")).isEmpty()


def test_write_corpus(spark, tmp_path):
    rows = [("ja", i, f"source {i}", f"target\t{i}") for i in range(30)] + [("vi", i, "#bad", "x") for i in range(5)]
    df = spark.createDataFrame(rows, "lang string, line_no bigint, src string, tgt string")
    summary = write_corpus([df.where("lang = 'ja'"), df.where("lang = 'vi'")], str(tmp_path / "c"), cap=20)
    assert {r.lang: r.pairs for r in summary.collect()} == {"ja": 20, "TOTAL": 20}
    lines = lines_of(spark, str(tmp_path / "c"))
    want = [f"<2ja> source {i}\ttarget {i}" for i in range(20)] + [f"<2en> target {i}\tsource {i}" for i in range(20)]
    assert sorted(lines) == sorted(want)
    assert write_corpus([df.where("lang = 'vi'")], str(tmp_path / "none")) is None
    assert not (tmp_path / "none").exists()


def test_records_are_numbered(spark, tmp_path):
    from bitexture.operators import corpus as C

    path = str(tmp_path / "records")
    rows = [({"en": f"source {i}", "vi": f"target {i}"},) for i in range(50)]
    spark.createDataFrame(rows, "translation map<string,string>").repartition(3).write.parquet(path)
    df = R.read_translations(spark, path, "vi")
    assert sorted(r.line_no for r in df.collect()) == list(range(50))
    assert C.cap_per_language(df, 10).count() == 10


def test_small_input_has_all_splits(spark, tmp_path):
    lines = tmp_path / "five.txt"
    lines.write_text("".join(f"line {i}\n" for i in range(5)))
    folder = str(tmp_path / "splits")
    paths, reused = X.reuse_or_split(spark, str(lines), folder)
    assert not reused and X.reuse_or_split(spark, str(lines), folder) == (paths, True)
    assert sum(spark.read.schema("value string").text(p).count() for p in paths.values()) == 5


def test_lines_are_numbered_over_many_blocks(spark, tmp_path):
    """Small blocks, several in a partition; the plan shuffles no line."""
    from bitexture.sources.text import read_numbered_lines

    lines = [f"line {i} " + "x" * (i % 37) for i in range(3000)]
    for part in range(6):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"f{part}.txt").write_text("".join(f"{x}\n" for x in lines[part * 500 : part * 500 + 500]))
    for size in ("2k", "100k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "100")
        try:
            df = read_numbered_lines(spark, str(tmp_path / "in"))
            assert sorted((r.line_no, r.value) for r in df.collect()) == list(enumerate(lines))
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
