"""Training-run analytics over loss, run and parameter tables.

``runs``: ``run_id, epoch, train, val`` and more, one row per epoch. A run has
at most some thousands of epochs, so windows over one run are small. Batch
losses are large: their running sums go through ``running_sums``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from bitexture.functions.arrays import PAD_ID
from bitexture.functions.scores import smoothed_nll
from bitexture.operators.ranks import integer_levels, running_sums

PATIENCE = 5
LOG_EVERY = 500
AVERAGED = 5
#: Values of a block, and blocks whose sums a task holds at a time.
BLOCK_VALUES = 4_096
_HELD_BLOCKS = 1_024


def masked_token_loss(tokens: DataFrame, keys: Sequence[str], pad: int = PAD_ID, smoothing: float = 0.0) -> DataFrame:
    """Mean loss per batch over the target tokens that are not padding, with
    their number. A batch of padding only has a NULL loss."""
    loss = -F.col("logprob")
    if smoothing:
        loss = smoothed_nll(F.col("logprob"), F.col("mean_logprob"), smoothing)
    real = F.col("target") != pad
    return tokens.groupBy(*keys).agg(
        F.avg(F.when(real, loss)).alias("loss"), F.count_if(real).alias("n_tokens")
    )


def epoch_loss(batches: DataFrame, keys: Sequence[str], mode: str = "batch_mean") -> DataFrame:
    """Loss per epoch. ``batch_mean``: mean of batch means, a short batch
    counts like a full one. ``token``: weighted by ``n_tokens``."""
    if mode == "batch_mean":
        value = F.avg("loss")
    elif mode == "token":
        value = F.sum(F.col("loss") * F.col("n_tokens")) / F.sum("n_tokens")
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return batches.groupBy(*keys).agg(
        F.coalesce(value, F.lit(float("inf"))).alias("loss"), F.count("loss").alias("n_batches")
    )


def best_epoch(runs: DataFrame) -> DataFrame:
    """Epoch with the lowest validation loss per run, the earliest on ties."""
    return runs.groupBy("run_id").agg(
        F.min_by("epoch", F.when(F.col("val").isNotNull(), F.struct("val", "epoch"))).alias("best_epoch"),
        F.min("val").alias("best_val"),
    )


def _by_epoch():
    return Window.partitionBy("run_id").orderBy("epoch")


def best_so_far(runs: DataFrame) -> DataFrame:
    """Adds the best earlier loss and whether the epoch strictly improved; an
    epoch without a loss did not."""
    before = _by_epoch().rowsBetween(Window.unboundedPreceding, -1)
    better = F.col("val") < F.coalesce(F.col("prev_best"), F.lit(float("inf")))
    return runs.withColumn("prev_best", F.min("val").over(before)).withColumn(
        "improved", F.coalesce(better, F.lit(False))
    )


def early_stop(runs: DataFrame, patience: int = PATIENCE) -> DataFrame:
    """Epochs that would have run: a run ends with the first epoch whose count
    of epochs without improvement reaches ``patience``. ``stopped`` marks it."""
    w = _by_epoch().rowsBetween(Window.unboundedPreceding, 0)
    step = F.row_number().over(_by_epoch())
    marked = best_so_far(runs).withColumn("__step", step)
    last = F.coalesce(F.max(F.when(F.col("improved"), F.col("__step"))).over(w), F.lit(0))
    marked = marked.withColumn("no_improve", (F.col("__step") - last).cast("bigint"))
    end = F.min(F.when(F.col("no_improve") >= patience, F.col("__step"))).over(Window.partitionBy("run_id"))
    return (
        marked.withColumn("__end", end)
        .where(F.col("__end").isNull() | (F.col("__step") <= F.col("__end")))
        .withColumn("stopped", F.coalesce(F.col("__step") == F.col("__end"), F.lit(False)))
        .drop("__end", "__step")
    )


def mark_best(runs: DataFrame) -> DataFrame:
    """Adds ``mark``: ``*`` on the first epoch with the lowest loss."""
    order = Window.partitionBy("run_id").orderBy(F.asc_nulls_last("val"), "epoch")
    return runs.withColumn("mark", F.when(F.row_number().over(order) == 1, "*").otherwise(""))


def running_loss(losses: DataFrame, every: int = LOG_EVERY) -> DataFrame:
    """Running mean loss per run at every ``every``-th batch.

    ``n`` numbers the batches of a run in order (unique, gaps allowed).
    """
    sums = running_sums(
        losses,
        ["run_id"],
        ["n"],
        integer_levels("n"),
        {"batches": F.lit(1).cast("bigint"), "total": F.col("loss")},
    )
    return sums.where(F.col("batches") % every == 0).select(
        "run_id", "n", "batches", (F.col("total").cast("double") / F.col("batches")).alias("running_mean")
    )


def running_step(runs: DataFrame, batches: str = "n_batches") -> DataFrame:
    """Adds ``step_num``, the optimizer steps taken up to the epoch's end."""
    w = _by_epoch().rowsBetween(Window.unboundedPreceding, 0)
    return runs.withColumn("step_num", F.sum(batches).over(w))


def _block_sums(key_kinds: list[pa.DataType], names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sums of the blocks that a task sees, by keys and block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, list] = {}

        def out() -> pa.RecordBatch:
            keys = [pa.array([k[i] for k in sums], kind) for i, kind in enumerate(key_kinds)]
            rows = list(sums.values())
            columns = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())]
            columns.append(pa.array([r[2] for r in rows], pa.list_(pa.float64())))
            return pa.RecordBatch.from_arrays([*keys, *columns], names=names)

        for batch in batches:
            keys = list(zip(*[c.to_pylist() for c in batch.columns[:-3]]))
            sizes, counts, values = batch.columns[-3:]
            for key, size, n, block in zip(keys, sizes.to_pylist(), counts.to_pylist(), values):
                held = block.values
                if held.null_count:
                    raise ValueError(f"a NULL among the values of {key}")
                x = held.to_numpy(zero_copy_only=False)
                seen = sums.get(key)
                if seen is None:
                    sums[key] = [size, n, x.astype(np.float64)]
                elif seen[0] != size:
                    raise ValueError(f"arrays of {seen[0]} and {size} values under {key}")
                else:
                    seen[1] += n
                    seen[2] += x
                if len(sums) >= _HELD_BLOCKS:
                    yield out()
                    sums = {}
        if sums:
            yield out()

    return run


def average_blocks(params: DataFrame, keys: Sequence[str] = ("name",)) -> DataFrame:
    """``keys, block, values``: element-wise mean of equally named arrays across
    checkpoints, in blocks of ``BLOCK_VALUES`` values.

    Arrays are cut into blocks, never into single values. Blocks are summed
    inside the tasks first, so a name that many checkpoints share costs one row
    per block and task, and then per block. Arrays of unequal length under one
    name, and NULLs in them, are refused; NULL arrays don't count.
    """
    keys = list(keys)
    place = [*keys, "block"]
    blocks = F.sequence(F.lit(0), F.greatest(F.ceil(F.size("values") / BLOCK_VALUES).cast("int") - 1, F.lit(0)))
    cut = params.where(F.col("values").isNotNull()).select(
        *keys, F.col("values").cast("array<double>").alias("values"), F.explode(blocks).alias("block")
    )
    each = cut.select(
        *place,
        F.size("values").cast("bigint").alias("__size"),
        F.lit(1).cast("bigint").alias("__n"),
        F.slice("values", F.col("block") * BLOCK_VALUES + 1, F.lit(BLOCK_VALUES)).alias("__sum"),
    )
    names = each.columns
    kinds = [to_arrow_type(each.schema[c].dataType) for c in place]
    sums = _block_sums(kinds, names)

    def total(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sums(group):
            n, values = batch.column(len(place) + 1)[0].as_py(), batch.column(len(place) + 2)[0].values.to_numpy()
            columns = [*batch.columns[: len(place)], pa.array([values / n], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*place, "values"])

    out = T.StructType([each.schema[c] for c in place]).add("values", T.ArrayType(T.DoubleType()))
    return each.mapInArrow(sums, each.schema).groupBy(*place).applyInArrow(total, out)


def average_vectors(params: DataFrame, keys: Sequence[str] = ("name",)) -> DataFrame:
    """``keys, values``: the blocks of ``average_blocks`` put together, for
    export. A whole array is one row here."""
    keys = list(keys)
    blocks = average_blocks(params, keys).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("block", "values"))).alias("__b"))
    return blocks.select(*keys, F.flatten(F.transform("__b", lambda b: b["values"])).alias("values"))


def param_count(params: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return params.groupBy(*keys).agg(F.sum(F.size("values")).alias("n_params"))


def last_k_artifacts(artifacts: DataFrame, k: int = AVERAGED, order: str = "name") -> DataFrame:
    """The last ``k`` artifacts by file name (text order) or ``epoch``."""
    if order not in ("name", "epoch"):
        raise ValueError(f"unknown order {order!r}")
    return artifacts.orderBy(F.desc(order), F.desc("name")).limit(k)


def best_k_artifacts(artifacts: DataFrame, k: int = AVERAGED) -> DataFrame:
    """The ``k`` artifacts with the lowest validation loss."""
    return artifacts.orderBy("val_loss", "name").limit(k)


def compare_models(metrics: DataFrame, first: str, second: str) -> DataFrame:
    """One row per metric (``model, metric, value`` in): both values, the
    difference and the winner. Loss and perplexity: lower wins; BLEU: higher
    wins and a missing value loses. ``second`` must win outright except
    against a missing value."""
    wide = metrics.groupBy("metric").pivot("model", [first, second]).agg(F.first("value"))
    a, b = F.col(f"`{first}`"), F.col(f"`{second}`")
    second_wins = F.when(F.col("metric") == "bleu", a.isNull() | (b > a)).otherwise(b < a)
    return wide.select(
        "metric",
        a.alias("value_first"),
        b.alias("value_second"),
        (a - b).alias("delta"),
        F.when(F.coalesce(second_wins, F.lit(False)), second).otherwise(first).alias("winner"),
    )
