"""Counters and status rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def client_status(rows: DataFrame) -> DataFrame:
    """Per client of (client, ws, scheduled, finished, and files if there): sums and its worksets."""
    sums = [F.sum(c).alias(c) for c in ("scheduled", "finished", "files") if c in rows.columns]
    active = F.sum(F.greatest(F.col("scheduled") - F.col("finished"), F.lit(0))).alias("active")
    return rows.groupBy("client").agg(
        *sums, active, F.count("*").alias("n_worksets"), F.array_join(F.transform(F.sort_array(F.collect_set("ws")), lambda x: x.cast("string")), ",").alias("worksets"))


def workset_status(rows: DataFrame) -> DataFrame:
    """Per workset of (ws, scheduled, finished, files): sums and what is waiting."""
    return rows.groupBy("ws").agg(
        F.sum("scheduled").alias("scheduled"), F.sum("finished").alias("finished"), F.sum("files").alias("files"),
    ).withColumn("active", F.greatest(F.col("scheduled") - F.col("finished"), F.lit(0)))


def priority_status(rows: DataFrame) -> DataFrame:
    """Per priority of (prio, buffered, files): sums, and a row of totals under null."""
    return rows.rollup("prio").agg(F.sum("buffered").alias("buffered"), F.sum("files").alias("files"))


def writer_status(rows: DataFrame) -> DataFrame:
    """Sums over the parallel files of a writer (buffered, bytes, files)."""
    return rows.agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("buffered", "bytes", "files")))


def compression(rows: DataFrame, url: str = "u", batch: str | None = None) -> DataFrame:
    """Average bytes of URLs, and of URLs compressed one by one; with ``batch``, bytes of each
    batch, plain and compressed together."""
    def packed(x):
        import zlib

        return x.map(lambda t: len(zlib.compress((t or "").encode())))

    size = F.pandas_udf(packed, "long")
    if batch is None:
        return rows.agg(F.avg(F.octet_length(url)).alias("bytes"), F.avg(size(url)).alias("packed"))
    together = rows.groupBy(batch).agg(F.array_join(F.array_sort(F.collect_list(url)), "\n").alias("_t"))
    return together.select(batch, F.octet_length("_t").alias("bytes"), size("_t").alias("packed")).withColumn("ratio", F.col("packed") / F.col("bytes"))


def submission_report(rows: DataFrame, ok: Column, url: str = "u", failed: Column | None = None, seconds: float | None = None) -> DataFrame:
    """Counts of submitted, dropped and failed rows, the ignored schemes, and the rate."""
    failed = F.lit(False) if failed is None else F.coalesce(failed, F.lit(False))
    scheme = F.when(~ok, F.substring_index(F.col(url), ":", 1))
    out = rows.agg(F.count_if(ok & ~failed).alias("count"), F.count_if(~ok).alias("dropped"), F.count_if(ok & failed).alias("failed"),
                   F.array_join(F.array_sort(F.collect_set(scheme)), ",").alias("ignored"))
    return out if seconds is None else out.withColumn("rate", per_second(F.col("count"), F.lit(float(seconds))))


def submit(rows: DataFrame, send: Callable[[list[dict]], bool], size: int = 500) -> DataFrame:
    """Send rows in chunks of ``size`` from where they are; (rows, sent) of each chunk. A send
    that returns false or fails counts its rows as not sent."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, size):
                chunk = b.slice(at, size).to_pylist()
                try:
                    sent = bool(send(chunk))
                except OSError:
                    sent = False
                yield pa.RecordBatch.from_pydict({"rows": [len(chunk)], "sent": [len(chunk) if sent else 0]})

    return rows.mapInArrow(run, "rows long, sent long")


def job_status_pivot(server_jobs: DataFrame) -> DataFrame:
    return server_jobs.groupBy("job").agg(F.array_join(F.sort_array(F.collect_list("server")), ",").alias("servers"), F.count("*").alias("n"))


def job_servers(registered: DataFrame, live: DataFrame) -> DataFrame:
    """Registered servers and those that are active without registration (svid null)."""
    extra = live.join(registered, ["job", "name"], "left_anti").withColumn("svid", F.lit(None).cast("int"))
    return registered.select("job", "name", "svid").unionByName(extra.select("job", "name", "svid"))


#: Seconds between snapshots, and rows in and out, beyond which no rate is shown.
MAX_GAP, MAX_IN, MAX_OUT = 3600, 1_000_000, 100_000


def rates(snapshots: DataFrame) -> DataFrame:
    """Rates between successive snapshots (key, ts, n, and out if there): null after too long
    a gap, or where a count went back or too far ahead."""
    w = W.partitionBy("key").orderBy("ts")
    x = snapshots.withColumn("dt", F.col("ts") - F.lag("ts").over(w))
    for c, rate, most in (("n", "rate", MAX_IN), ("out", "out_rate", MAX_OUT)):
        if c in snapshots.columns:
            x = x.withColumn("_d", F.col(c) - F.lag(c).over(w))
            x = x.withColumn(rate, F.when((F.col("dt") > 0) & (F.col("dt") < MAX_GAP) & F.col("_d").between(0, most), F.col("_d") / F.col("dt")))
    return x.drop("_d")


def with_comma(n: Column) -> Column:
    """A whole number with a comma before every three digits; ``-?-`` for none."""
    return F.coalesce(F.format_number(n, 0), F.lit("-?-"))


def time_delta(ms: Column) -> Column:
    """Signed hours, minutes, seconds and milliseconds; leading units that are zero are left
    out, down to the seconds; ``-`` for none."""
    d = F.abs(ms)
    out = F.format_string("%ds%dms", F.floor(d / 1000) % 60, d % 1000)
    out = F.when(d >= 60_000, F.concat(F.format_string("%dm", F.floor(d / 60_000) % 60), out)).otherwise(out)
    out = F.when(d >= 3_600_000, F.concat(F.format_string("%dh", F.floor(d / 3_600_000)), out)).otherwise(out)
    return F.coalesce(F.concat(F.when(ms < 0, "-").otherwise(""), out), F.lit("-"))


def transitions(activity: DataFrame, gap: int = 36_000) -> DataFrame:
    """Feeds (client, ts) with ``activates``: the first, or the first after a gap of 10 hours."""
    prev = F.lag("ts").over(W.partitionBy("client").orderBy("ts"))
    return activity.withColumn("activates", prev.isNull() | (F.col("ts") - prev > gap))


def per_second(n: Column, t: Column) -> Column:
    return F.when(t == 0, 0.0).otherwise(n / t)
