"""Streams over the given tables, run to the end of what is there."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from bitexture.plans import inputs as I
from bitexture.plans.registry import query
from bitexture.plans.text_queries import SQL_STATUS
from bitexture.session import shared_dir
from bitexture.streaming.jobs import debounce_stream as debounce_rows
from bitexture.streaming.jobs import stream_requests as check_rows
from bitexture.streaming.jobs import write_available

q = I.with_inputs


def _table_stream(spark, sf, name):
    """A table as a stream, be it one file or a folder of part files: a stream
    takes a single file by a pattern only."""
    schema = spark.read.parquet(f"{sf}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf}/{{{name}}}.parquet")


def _run(spark, stream):
    """Drains a stream into a fresh table in the shared folder and reads it."""
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    running = write_available(stream, f"{base}/rows", f"{base}/state")
    running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")


@query(
    q(
        f"""SELECT req_id, CAST(CASE WHEN detail IS NULL THEN 200 ELSE 400 END AS INTEGER) AS status, detail,
              detail IS NULL AND source_lang <> 'en' AND target_lang <> 'en' AS "pivot",
              CASE WHEN source_lang = 'en' THEN {I.sql_english('t')} ELSE t END AS source
            FROM (SELECT *, {SQL_STATUS} AS detail, {I.sql_strip('source_text')} AS t FROM requests)""",
        "requests",
    )
)
def stream_requests(spark, sf):
    requests = I.as_requests(_table_stream(spark, sf, "conversations"))
    checked = check_rows(requests, I.LANGS, "en")
    return _run(spark, checked.select("req_id", "status", "detail", "pivot", "source"))


@query(
    """SELECT user_id, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) + 1800000000 AS fires_us, count(*) AS n_inputs,
         arg_max(event_id, epoch_us(ts)) AS text FROM (
         SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS burst FROM (
           SELECT *, CASE WHEN coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)), 1e18) > 1800000000
                     THEN 1 ELSE 0 END AS new FROM events)) GROUP BY user_id, burst
       HAVING epoch_us(max(ts)) + 1800000000 <= (SELECT epoch_us(max(ts)) - 600000000 FROM events)"""
)
def debounce_stream(spark, sf):
    """Bursts that the watermark has passed (the rest is still open)."""
    events = _table_stream(spark, sf, "events").select("user_id", "ts", F.col("event_id").alias("text"))
    out = debounce_rows(events, "30 minutes")
    us = {c: F.unix_micros(c) for c in ("first_at", "fires_at")}
    return _run(spark, out).select(
        "user_id", us["first_at"].alias("first_us"), us["fires_at"].alias("fires_us"), "n_inputs", "text"
    )
