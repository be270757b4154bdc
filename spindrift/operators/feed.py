"""Scheduling: round-robin feed, priority order, results of fetches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def feed(rows: DataFrame, n: int, cursor: int, worksets: int) -> DataFrame:
    """Rows (ws_index, seq) that a client gets for a request of n, in order ``pos``.

    Worksets take turns from ``cursor``; a turn gives a chunk of n div 4 + 1 rows, and a
    chunk is given whole if fewer than n rows came before it. No workset can give more
    than n + chunk rows, so that all but these are dropped before the common order.
    """
    chunk = n // 4 + 1
    rn = F.row_number().over(W.partitionBy("ws_index").orderBy("seq"))
    x = rows.withColumn("rn", rn).where(F.col("rn") <= n + chunk)
    x = x.withColumns({"round": F.floor((F.col("rn") - 1) / chunk), "turn": F.pmod(F.col("ws_index") - cursor, F.lit(worksets))})
    x = x.orderBy("round", "turn", "rn").limit(n + chunk)
    order = W.orderBy("round", "turn", "rn")  # over n + chunk rows
    x = x.withColumn("pos", F.row_number().over(order))
    x = x.withColumn("before", F.min("pos").over(W.partitionBy("round", "turn")) - 1)
    return x.where(F.col("before") < n).drop("rn", "round", "turn", "before")


def next_cursor(fed: DataFrame, worksets: int) -> DataFrame:
    return fed.agg(((F.max_by("ws_index", "pos") + 1) % worksets).alias("cursor"))


def priority_burst(rows: DataFrame, cap: int = 10_000) -> DataFrame:
    """At most ``cap`` rows of each priority per trigger."""
    return rows.withColumn("rn", F.row_number().over(W.partitionBy("prio").orderBy("seq"))).where(F.col("rn") <= cap)


def makecuri(rows: DataFrame) -> DataFrame:
    """Lift p, v and x out of ``a`` over those of the row; an ``a`` that holds nothing else goes."""
    own = [f for f in rows.schema["a"].dataType.names if f not in "pvx"]
    out = rows.withColumns({k: F.coalesce(F.col(f"a.{k}"), F.col(k)) for k in "pvx"})
    if not own:
        return out.drop("a")
    some = F.coalesce(*(F.col(f"a.{k}").cast("string") for k in own)).isNotNull()
    return out.withColumn("a", F.when(some, F.struct(*(F.col(f"a.{k}").alias(k) for k in own))))


def priority_order(rows: DataFrame) -> DataFrame:
    """Rows (prio, file, pos) in the order in which they are read: strictly by priority, then
    by segment name, then by place."""
    return rows.orderBy("prio", "file", "pos")


def next_segment(rows: DataFrame) -> DataFrame:
    """The rows of the first segment of the first priority that has any."""
    first = rows.agg(F.min(F.struct("prio", "file")).alias("s")).select("s.*")
    return rows.join(F.broadcast(first), ["prio", "file"], "left_semi")


def in_chunks(rows: DataFrame, size: int, by: str, order: str = "seq") -> DataFrame:
    """Append ``chunk``: the rows of each ``by``, in order, ``size`` to a chunk."""
    return rows.withColumn("chunk", F.floor((F.row_number().over(W.partitionBy(by).orderBy(order)) - 1) / size))


def finished_by_workset(rows: DataFrame) -> DataFrame:
    return rows.groupBy("ws").agg(F.count("*").alias("finished"))


def upsert(info: DataFrame, new: DataFrame) -> DataFrame:
    """Latest result per id of (id, seq, s, d); rows without a result change nothing."""
    both = info.unionByName(new.where("s is not null"))
    return both.groupBy("id").agg(F.max_by(F.struct("seq", "s", "d"), "seq").alias("r")).select("id", "r.*")


def enrich(rows: DataFrame, info: DataFrame) -> DataFrame:
    """Result of the info store where the row has none."""
    return rows.join(info.select("id", F.col("s").alias("_s")), "id", "left").withColumn("s", F.coalesce("s", "_s")).drop("_s")


def expiry(finished_at, days: int = 60):
    return finished_at + days * 86400


#: Checkout states of a stored row: waiting, or done; a positive state is the time of the checkout.
WAITING, DONE = 0, -1


def checkout(rows: DataFrame, n: int, now: int, expire: int | None = None) -> DataFrame:
    """Rows (ws, seq, co) with ``co`` set to ``now`` for the first n waiting ones of each
    workset, and back to waiting first for those checked out ``expire`` seconds ago or more."""
    state = F.col("co")
    if expire is not None:
        state = F.when((state > 0) & (state <= now - expire), WAITING).otherwise(state)
    x = rows.withColumn("co", state)
    rank = F.row_number().over(W.partitionBy("ws", F.col("co") == WAITING).orderBy("seq"))
    return x.withColumn("_n", rank).withColumn("co", F.when((F.col("co") == WAITING) & (F.col("_n") <= n), now).otherwise(F.col("co"))).drop("_n")


def check_in(rows: DataFrame, finished: DataFrame) -> DataFrame:
    """Rows (id, co) with the state DONE for those in ``finished`` (id)."""
    done = finished.select("id").distinct().withColumn("_done", F.lit(True))
    return rows.join(done, "id", "left").withColumn("co", F.when(F.col("_done"), DONE).otherwise(F.col("co"))).drop("_done")


def low_worksets(rows: DataFrame, least: int = 500) -> DataFrame:
    """Worksets (ws, waiting) that hold fewer than ``least`` waiting rows and are to be loaded."""
    return rows.groupBy("ws").agg(F.count_if(F.col("co") == WAITING).alias("waiting")).where(F.col("waiting") < least)
