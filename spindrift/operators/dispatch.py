"""Routing of a discovered batch, and its check against the seen set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.functions.fingerprint import frontier_id
from spindrift.operators.assignment import with_workset
from spindrift.operators.domains import with_domain_info
from spindrift.schemas import NEVER


def active_clients(activity: DataFrame, now, timeout: str = "10 hours") -> DataFrame:
    """Clients (client, last_feed) that fed within the timeout; never fed is inactive."""
    return activity.where(F.col("last_feed") > F.lit(now).cast("timestamp") - F.expr(f"interval {timeout}")).select("client")


def route(rows: DataFrame, wscl: DataFrame, active: DataFrame, info: DataFrame) -> DataFrame:
    """Append id, ws, client and ``route``: saved, excluded or candidate, in this order.

    Routes are given before duplicates go, so that saved and excluded rows count each.
    """
    placed = with_workset(rows.withColumn("id", frontier_id("u"))).join(F.broadcast(wscl), "ws", "left")
    placed = placed.join(F.broadcast(active.distinct().withColumn("active", F.lit(True))), "client", "left")
    placed = with_domain_info(placed, info)
    return placed.withColumn(
        "route",
        F.when(F.col("active").isNull(), "saved").when(F.coalesce("exclude", F.lit(0)) != 0, "excluded").otherwise("candidate"),
    )


def first_per_key(rows: DataFrame, key: str = "id", seq: str = "seq") -> DataFrame:
    """The first row of each key by ``seq``, as a map-side combined aggregate."""
    return rows.groupBy(key).agg(F.min_by(F.struct(*[c for c in rows.columns if c != key]), seq).alias("_r")).select(key, "_r.*")


def last_per_key(rows: DataFrame, key: str = "id", seq: str = "seq") -> DataFrame:
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), seq).alias("_r")).select(key, "_r.*")


def unseen(rows: DataFrame, seen: DataFrame, strict: bool = False) -> DataFrame:
    """Merge mode: the first row of each key that the seen set lacks.

    Forced rows (f) pass whatever was seen, unless ``strict``.
    """
    keys = seen.select(F.col("key").alias("id"))
    fresh = first_per_key(rows if strict else rows.where("coalesce(f, 0) = 0")).join(keys, "id", "left_anti")
    return fresh if strict else fresh.unionByName(rows.where("coalesce(f, 0) <> 0"))


def lookup_check(rows: DataFrame, seen: DataFrame, now: int) -> DataFrame:
    """Lookup mode over (id, seq, f, e): rows to schedule, with the fields that go out.

    Forced rows pass without id. Of a key that was never seen, or whose expiry ``e`` is in
    the past, the first row passes; it then never expires.
    """
    forced = rows.where("coalesce(f, 0) <> 0").withColumn("id", F.lit(None).cast("long"))
    known = seen.select(F.col("key").alias("id"), F.col("e").alias("_e"))
    checked = first_per_key(rows.where("coalesce(f, 0) = 0")).join(known, "id", "left")
    passed = checked.where(F.coalesce("_e", F.lit(0)) < now).drop("_e")
    return forced.unionByName(passed)


def hops(rows: DataFrame) -> DataFrame:
    """p, v and x of ``w`` if it is an object, else of the row; not field by field."""
    return rows.withColumns({k: F.when(F.col("w").isNotNull(), F.col(f"w.{k}")).otherwise(F.col(k)) for k in "pvx"})


def merge_union(rows: DataFrame, seen: DataFrame) -> DataFrame:
    """The next seen set: existing records stay, new keys come with ts 0."""
    new = rows.select(F.col("id").alias("key"), F.lit(0).cast("long").alias("ts"), F.lit(1).alias("_new"))
    old = seen.select("key", F.col("ts").cast("long").alias("ts"), F.lit(0).alias("_new"))
    return old.union(new).groupBy("key").agg(F.min_by("ts", F.struct("_new", -F.col("ts"))).alias("ts"))


def counters(routed: DataFrame, seen: DataFrame, strict: bool = False) -> DataFrame:
    """processed = excluded + saved + scheduled + seen, in one row and one pass over ``routed``.

    Scheduled are the distinct ids of candidates that the seen set lacks, and, unless
    ``strict``, every forced candidate.
    """
    known = seen.select(F.col("key").alias("id"), F.lit(True).alias("_known"))
    forced = F.lit(False) if strict or "f" not in routed.columns else F.coalesce("f", F.lit(0)) != 0
    candidate = F.col("route") == "candidate"
    fresh = candidate & ~forced & F.col("_known").isNull()
    per_id = routed.join(known, "id", "left").groupBy("id").agg(
        F.count("*").alias("n"), F.count_if(F.col("route") == "excluded").alias("excluded"), F.count_if(F.col("route") == "saved").alias("saved"),
        F.count_if(candidate & forced).alias("forced"), F.max(fresh.cast("int")).alias("fresh"))
    total = {c: F.coalesce(F.sum(x), F.lit(0)).cast("long") for c, x in (("processed", "n"), ("excluded", "excluded"), ("saved", "saved"))}
    total["scheduled"] = F.coalesce(F.sum(F.col("forced") + F.col("fresh")), F.lit(0)).cast("long")
    return per_id.agg(*(x.alias(c) for c, x in total.items())).withColumn("seen", F.expr("processed - excluded - saved - scheduled"))


def seen_record(keys: DataFrame) -> DataFrame:
    return keys.select(F.col("id").alias("key"), F.lit(NEVER).cast("long").alias("e"))
