"""Request checking and input debouncing as streams (and in batch)."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from bitexture.functions import predicates as P
from bitexture.operators.requests import check_requests
from bitexture.session import stored

TYPING_PAUSE = "500 milliseconds"


def stream_requests(
    requests: DataFrame, languages: Sequence[str] = P.LISTED_LANGUAGES, english: str = "Tiếng Anh"
) -> DataFrame:
    """Validation, normalization and routing of a request stream: stateless,
    the same columns as in batch."""
    return check_requests(requests, languages, english)


def write_available(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Runs a stream over what is there now, into Parquet files, exactly once
    across restarts with the same ``checkpoint``."""
    return (
        df.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def debounce_stream(
    inputs: DataFrame, gap: str = TYPING_PAUSE, late: str = "10 minutes", user: str = "user_id", ts: str = "ts", value: str = "text"
) -> DataFrame:
    """One row per burst of inputs of a user: fires ``gap`` after its last
    input, with the last value. State is dropped as the watermark passes."""
    at = F.timestamp_micros(_micros(inputs, ts))
    return (
        inputs.select(user, value, at.alias("__at"))
        .withWatermark("__at", late)
        .groupBy(user, F.session_window("__at", gap).alias("w"))
        .agg(F.count(F.lit(1)).alias("n_inputs"), F.max_by(value, F.struct("__at", value)).alias(value))
        .select(user, F.col("w.start").alias("first_at"), F.col("w.end").alias("fires_at"), "n_inputs", value)
    )


def _micros(df: DataFrame, ts: str) -> Column:
    """Microseconds since the epoch; a time without zone counts as UTC."""
    at = F.col(ts).cast("timestamp")
    if isinstance(df.schema[ts].dataType, T.TimestampNTZType):
        at = F.from_utc_timestamp(at, F.current_timezone())
    return F.unix_micros(at)


def _bursts(kind: T.StructType, gap_us: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Bursts within one partition that is sorted by user, time and value. The
    first and the last one may go on in another partition and are marked."""

    def apart(a: pa.Array, b: pa.Array) -> np.ndarray:
        same = pc.fill_null(pc.equal(a, b), False).to_numpy(zero_copy_only=False)
        nulls = pc.and_(pc.is_null(a), pc.is_null(b)).to_numpy(zero_copy_only=False)
        return ~(same | nulls)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_one: pa.RecordBatch | None = None  # the burst that the next batch may go on with
        first = True
        for batch in batches:
            user, at, value = batch.columns
            n = batch.num_rows
            if not n:
                continue
            us = at.to_numpy(zero_copy_only=False)
            cut = np.concatenate([[True], apart(user[1:], user[:-1]) | (np.diff(us) > gap_us)])
            starts = np.flatnonzero(cut)
            ends = np.append(starts[1:], n) - 1
            since, sizes = us[starts].copy(), ends - starts + 1
            if open_one is not None:
                more = not apart(user[:1], open_one["u"])[0] and us[0] - open_one["to"][0].as_py() <= gap_us
                if more:
                    since[0] = open_one["from"][0].as_py()
                    sizes[0] += open_one["n"][0].as_py()
                else:
                    yield open_one.append_column("edge", pa.array([first])).rename_columns(kind.fieldNames())
                    first = False
            found = pa.RecordBatch.from_arrays(
                [user.take(pa.array(ends)), pa.array(since), pa.array(us[ends]), pa.array(sizes), value.take(pa.array(ends))],
                names=["u", "from", "to", "n", "v"],
            )
            whole = found.slice(0, len(starts) - 1)
            if whole.num_rows:
                edge = np.zeros(whole.num_rows, bool)
                edge[0], first = first, False
                yield whole.append_column("edge", pa.array(edge)).rename_columns(kind.fieldNames())
            open_one = found.slice(len(starts) - 1)
        if open_one is not None:
            yield open_one.append_column("edge", pa.array([True])).rename_columns(kind.fieldNames())

    return run


def debounce(
    inputs: DataFrame, gap_us: int = 500_000, user: str = "user_id", ts: str = "ts", value: str = "text"
) -> DataFrame:
    """Batch form of ``debounce_stream``. Inputs are dealt by ranges of user and
    time, so one user's inputs may fill all tasks; of equal ones those of
    different input partitions may go apart.

    Bursts are formed inside a partition in one pass. Only its first and last
    one can belong to a burst of another partition: these two per partition are
    joined up, all others are final. Inputs without time are left out; of the
    last inputs at the same time the largest value counts.
    """
    order = ["__user", "__us", "__value", "__part"]
    dealt = (
        inputs.select(F.col(user).alias("__user"), _micros(inputs, ts).alias("__us"), F.col(value).alias("__value"))
        .where(F.col("__us").isNotNull())
        .withColumn("__part", F.spark_partition_id())
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
    )
    kind = (
        T.StructType().add("__user", inputs.schema[user].dataType).add("__from", T.LongType()).add("__to", T.LongType())
        .add("__n", T.LongType()).add("__value", inputs.schema[value].dataType).add("__edge", T.BooleanType())
    )
    # written once: both uses below have to see the same ranges
    local = stored(dealt.select("__user", "__us", "__value").mapInArrow(_bursts(kind, gap_us), kind), "bursts")
    out = ["__user", "__from", "__to", "__n", "__value"]
    inner = local.where(~F.col("__edge")).select(*out)
    # two rows per partition; a session of [from, to + gap) spans
    span = F.concat((F.col("__to") - F.col("__from") + gap_us).cast("string"), F.lit(" microseconds"))
    edges = (
        local.where(F.col("__edge"))
        .groupBy("__user", F.session_window(F.timestamp_micros("__from"), span).alias("w"))
        .agg(
            F.min("__from").alias("__from"),
            F.sum("__n").alias("__n"),
            F.max_by("__value", F.struct("__to", "__value")).alias("__value"),
            F.max("__to").alias("__to"),
        )
        .select(*out)
    )
    return inner.unionByName(edges).select(
        F.col("__user").alias(user),
        F.timestamp_micros("__from").alias("first_at"),
        F.timestamp_micros(F.col("__to") + gap_us).alias("fires_at"),
        F.col("__n").alias("n_inputs"),
        F.col("__value").alias(value),
    )
