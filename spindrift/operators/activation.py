"""Clients that begin and cease to feed, and what this does to saved rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Seconds without a feed after which a client is inactive.
TIMEOUT = 36_000


def newly_active(before: DataFrame, now: DataFrame) -> DataFrame:
    """Clients (client) that are active now and were not before."""
    return now.select("client").distinct().join(before.select("client"), "client", "left_anti")


def reactivate(saved: DataFrame, wscl: DataFrame, activated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Saved rows (ws, ...) in two: those of activated clients, which go back to the queue with
    priority 0, and those that stay saved."""
    mine = wscl.join(F.broadcast(activated.select("client").distinct()), "client", "left_semi").select("ws").distinct()
    back = saved.join(F.broadcast(mine), "ws", "left_semi").withColumn("prio", F.lit(0))
    return back, saved.join(F.broadcast(mine), "ws", "left_anti")


def deactivations(activity: DataFrame, now: int, timeout: int = TIMEOUT) -> DataFrame:
    """Periods (client, since, until) that feeds (client, ts) make: a gap over ``timeout`` ends
    one, and so does ``now`` if it is that far; until is null for a client that is active."""
    w = W.partitionBy("client").orderBy("ts")
    begins = F.lag("ts").over(w).isNull() | (F.col("ts") - F.lag("ts").over(w) > timeout)
    spells = activity.withColumn("_b", begins.cast("int")).withColumn("_spell", F.sum("_b").over(w))
    out = spells.groupBy("client", "_spell").agg(F.min("ts").alias("since"), F.max("ts").alias("last"))
    later = F.lead("since").over(W.partitionBy("client").orderBy("since"))
    over = later.isNotNull() | (F.lit(now) - F.col("last") > timeout)
    return out.withColumn("until", F.when(over, F.col("last") + timeout)).select("client", "since", "until")


def flushed_worksets(rows: DataFrame, wscl: DataFrame, before: DataFrame, now: DataFrame) -> DataFrame:
    """Worksets (ws) with rows whose client was active before and is not now."""
    ceased = newly_active(now, before)
    return rows.select("ws").distinct().join(F.broadcast(wscl.join(F.broadcast(ceased), "client", "left_semi")), "ws", "left_semi")
