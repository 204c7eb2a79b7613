"""Line files: tagged TSV, parallel text and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bitexture.functions.predicates import non_blank_line
from bitexture.functions.text import WHITESPACE, flatten_newlines, strip_unicode, untab
from bitexture.operators.corpus import tagged_line
from bitexture.operators.lookup import zip_lines
from bitexture.operators.ranks import shuffle_key
from bitexture.operators.shuffle import RATIOS, SPLITS, split_exact
from bitexture.sources.paths import path_exists

# File blocks of one input; their list, of some 30 bytes each, goes to all tasks.
MAX_BLOCKS = 8_000_000


def read_numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``line_no, value``: lines with their 0-based number, over the files of
    ``path`` in name order.

    Lines are numbered inside each file block as they are read; the blocks'
    line counts give every block its first number. One row per block is sent to
    the tasks, about one byte for every four million read, whatever the
    input's size; lines themselves are neither sorted nor shuffled. An input of
    more than ``MAX_BLOCKS`` blocks (a petabyte in usual ones) is refused.
    """
    lines = spark.read.text(path).select(
        F.xxhash64("_metadata.file_path").alias("__file"),
        F.col("_metadata.file_path").alias("__path"),
        F.col("_metadata.file_block_start").alias("__start"),
        F.monotonically_increasing_id().alias("__id"),
        "value",
    )
    blocks = lines.groupBy("__file", "__start").agg(
        F.count(F.lit(1)).alias("__n"), F.min("__id").alias("__first"), F.min("__path").alias("__path"), F.max("__path").alias("__other")
    )
    earlier = Window.orderBy("__path", "__start").rowsBetween(Window.unboundedPreceding, -1)
    lost = F.when(F.col("__path") != F.col("__other"), F.raise_error(F.lit("two files share a hash")))
    many = F.when(F.count(F.lit(1)).over(earlier) >= MAX_BLOCKS, F.raise_error(F.lit(f"more than {MAX_BLOCKS} file blocks")))
    before = F.coalesce(lost.cast("bigint"), many.cast("bigint"), F.sum("__n").over(earlier), F.lit(0))
    blocks = blocks.select("__file", "__start", (before - F.col("__first")).alias("__shift"))
    # a block that was cut differently in the two reads must not pass silently
    shift = F.coalesce("__shift", F.raise_error(F.lit("file blocks changed between reads")).cast("bigint"))
    return lines.join(F.broadcast(blocks), ["__file", "__start"], "left").select(
        (shift + F.col("__id")).alias("line_no"), "value"
    )


def read_parallel_text(spark: SparkSession, src_path: str, tgt_path: str) -> DataFrame:
    """``line_no, src, tgt`` from two line-aligned files, as long as the
    shorter one; empty if a file is missing."""
    for path in (src_path, tgt_path):
        if not path_exists(spark, path):
            return spark.createDataFrame([], "line_no bigint, src string, tgt string")
    a = read_numbered_lines(spark, src_path).withColumnRenamed("value", "src")
    b = read_numbered_lines(spark, tgt_path).withColumnRenamed("value", "tgt")
    return zip_lines(a, b)


def parse_tagged(value: Column) -> Column:
    """Struct ``src, tgt, status`` of a line: ``ok``, ``blank`` or ``bad`` (no
    TAB, or an empty side). Cut at the first TAB only."""
    return _parts(strip_unicode(value))


def _parts(line: Column) -> Column:
    """``parse_tagged`` of a stripped line. It begins and ends with a sign, so
    with a TAB neither side is empty, and only the inner ends need stripping. A
    pattern is used only for lines with several TABs."""
    space = F.lit(WHITESPACE)
    several = F.substring_index(line, "\t", 2) != line
    after = F.when(several, F.get(F.split(line, "\t", 2), F.lit(1))).when(line.contains("\t"), F.substring_index(line, "\t", -1))
    status = F.when(line == "", "blank").when(F.coalesce(line.contains("\t"), F.lit(False)), "ok").otherwise("bad")
    return F.struct(
        F.rtrim(F.substring_index(line, "\t", 1), space).alias("src"), F.ltrim(after, space).alias("tgt"), status.alias("status")
    )


def _parsed(lines: DataFrame) -> DataFrame:
    """``src, tgt, status``. What follows a generator isn't merged into it, so
    each line is stripped once and cut once."""
    stripped = lines.select(F.inline(F.array(F.struct(strip_unicode(F.col("value")).alias("__line")))))
    return stripped.select(F.inline(F.array(_parts(F.col("__line")))))


def parse_tagged_lines(lines: DataFrame) -> DataFrame:
    """Good rows ``src, tgt`` of a ``value`` table."""
    return _parsed(lines).where("status = 'ok'").select("src", "tgt")


def tagged_line_stats(lines: DataFrame) -> DataFrame:
    """One row: ``good, bad, blank`` line counts."""
    return _parsed(lines).agg(*[F.count_if(F.col("status") == s).alias(n) for s, n in (("ok", "good"), ("bad", "bad"), ("blank", "blank"))])


def read_tagged_tsv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(pairs, counts)`` of a tagged file; use either or both."""
    if not path_exists(spark, path):
        raise FileNotFoundError(path)
    lines = spark.read.text(path)
    return parse_tagged_lines(lines), tagged_line_stats(lines)


def _one_line(c: Column, newline_policy: str) -> Column:
    if newline_policy == "space":
        return flatten_newlines(c)
    if newline_policy == "keep":
        return c
    raise ValueError(f"unknown newline policy {newline_policy!r}")


def write_tagged_tsv(df: DataFrame, path: str, newline_policy: str = "space", mode: str = "errorifexists") -> None:
    """``src TAB tgt`` lines; tabs inside text become blanks. Line feeds become
    blanks too, unless ``keep`` asks for the raw text."""
    cols = {c: untab(_one_line(F.col(c), newline_policy)) for c in ("src", "tgt")}
    df.withColumns(cols).select(tagged_line().alias("value")).write.mode(mode).text(path)


def write_parallel_text(
    df: DataFrame,
    folder: str,
    src: str = "en",
    tgt: str = "xx",
    newline_policy: str = "space",
    mode: str = "errorifexists",
) -> tuple[str, str]:
    """Two aligned line files ``train.src-tgt.src`` and ``.tgt``. Both are
    written in ``line_no`` order, so line ``i`` of one belongs to line ``i`` of
    the other whatever the part files are."""
    paths = []
    for column, lang in (("src", src), ("tgt", tgt)):
        path = f"{folder}/train.{src}-{tgt}.{lang}"
        value = _one_line(F.col(column), newline_policy).alias("value")
        df.select("line_no", value).orderBy("line_no").select("value").write.mode(mode).text(path)
        paths.append(path)
    return paths[0], paths[1]


def split_paths(folder: str) -> dict[str, str]:
    return {s: f"{folder}/split={s}" for s in SPLITS}


def write_splits(df: DataFrame, folder: str, mode: str = "errorifexists") -> dict[str, str]:
    """One folder of ``value`` lines per split, in one pass; an empty split has
    an empty folder. Rows keep the order of ``df`` within a split."""
    spark, paths = df.sparkSession, split_paths(folder)
    df.select("value", "split").write.mode(mode).partitionBy("split").text(folder)
    for path in paths.values():
        if not path_exists(spark, path):
            spark.createDataFrame([], "value string").write.text(path)
    return paths


def reuse_or_split(
    spark: SparkSession,
    lines_path: str,
    folder: str,
    reuse: bool = True,
    ratios: tuple[float, float, float] = RATIOS,
    seed: str = "42",
) -> tuple[dict[str, str], bool]:
    """Split paths, and whether existing ones were reused. A split is made
    from the non-blank lines of ``lines_path`` unless all three are there; with
    ``reuse=False`` an existing split is replaced."""
    paths = split_paths(folder)
    if reuse and all(path_exists(spark, p) for p in paths.values()):
        return paths, True
    if not path_exists(spark, lines_path):
        raise FileNotFoundError(lines_path)
    lines = read_numbered_lines(spark, lines_path).where(non_blank_line(F.col("value")))
    if lines.isEmpty():
        raise ValueError(f"no lines in {lines_path}")
    split = split_exact(lines, ["line_no"], ratios, seed)
    shuffled = split.withColumn("__key", shuffle_key(seed, "line_no")).orderBy("split", "__key", "line_no")
    write_splits(shuffled, folder, "errorifexists" if reuse else "overwrite")
    return paths, False
