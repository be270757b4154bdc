"""Maintenance of seen sets: integrity, repair, conversion, windows, novelty."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spindrift.functions.fingerprint import frontier_id


def integrity(records: DataFrame) -> DataFrame:
    """Counts over (pos, key): records, out-of-order and duplicate neighbours, first and last.

    Positions may have gaps. Ranges of positions are looked at apart, and the last record
    of each meets the first of the next, so that no task holds the file.
    """
    width = 1 << 20
    x = records.withColumn("_r", F.floor(F.col("pos") / width))
    prev = F.lag("key").over(W.partitionBy("_r").orderBy("pos"))
    x = x.withColumn("_prev", prev)
    per = x.groupBy("_r").agg(
        F.count("*").alias("records"), F.count_if(F.col("key") < F.col("_prev")).alias("out_of_order"), F.count_if(F.col("key") == F.col("_prev")).alias("duplicates"),
        F.min_by("key", "pos").alias("first"), F.max_by("key", "pos").alias("last"))
    # a row per range: a file of 10^11 records has 10^5
    per = per.withColumn("_before", F.lag("last").over(W.orderBy("_r")))
    return per.agg(
        F.coalesce(F.sum("records"), F.lit(0)).cast("long").alias("records"),
        F.coalesce(F.sum(F.col("out_of_order") + F.coalesce((F.col("first") < F.col("_before")).cast("long"), F.lit(0))), F.lit(0)).cast("long").alias("out_of_order"),
        F.coalesce(F.sum(F.col("duplicates") + F.coalesce((F.col("first") == F.col("_before")).cast("long"), F.lit(0))), F.lit(0)).cast("long").alias("duplicates"),
        F.min_by("first", "_r").alias("first"), F.max_by("last", "_r").alias("last"),
    ).withColumn("ok", (F.col("out_of_order") == 0) & (F.col("duplicates") == 0))


def rebuild(results: DataFrame) -> DataFrame:
    """The seen set (key, ts) of crawl results (u, m): every URL once, with its latest time."""
    return results.select(frontier_id("u").alias("key"), F.coalesce("m", F.lit(0)).cast("long").alias("ts")).groupBy("key").agg(F.max("ts").alias("ts"))


def lookup(seen: DataFrame, keys: list[int]) -> DataFrame:
    """The records of a few keys."""
    return seen.where(F.col("key").isin(keys))


def probe(rows: DataFrame, seen: DataFrame) -> DataFrame:
    """How many rows (id) there are, and how many of them the seen set holds."""
    known = seen.select(F.col("key").alias("id"), F.lit(1).alias("_k"))
    return rows.join(known, "id", "left").agg(F.count("*").alias("rows"), F.count("_k").alias("hits"))


def replay(rows: DataFrame, journal: DataFrame) -> DataFrame:
    """Rows (pos) that a journal of scheduled and seen places (pos) does not name."""
    return rows.join(journal.select("pos").distinct(), "pos", "left_anti")


def repair(*parts: DataFrame) -> DataFrame:
    """Union of seen sets (key, ts) with the latest record per key."""
    return reduce(DataFrame.unionByName, parts).groupBy("key").agg(F.max("ts").alias("ts"))


def convert_v1(keys: DataFrame) -> DataFrame:
    return keys.select("key", F.lit(0).cast("long").alias("ts"))


def id_window(rows: DataFrame) -> DataFrame:
    """Append ``win``, the top ten bits of the id."""
    return rows.withColumn("win", F.shiftright("id", 54).bitwiseAND(F.lit(1023)).cast("int"))


def novelty(rows: DataFrame) -> DataFrame:
    return rows.agg(F.countDistinct("id").alias("distinct_ids"), F.count("*").alias("all_ids")).withColumn(
        "novelty", F.when(F.col("all_ids") == 0, 0.0).otherwise(F.col("distinct_ids") / F.col("all_ids")))


def sorted_segment(rows: DataFrame) -> DataFrame:
    """Last row per id of each segment (file, pos, id); order by id is the caller's."""
    keep = F.row_number().over(W.partitionBy("file", "id").orderBy(F.desc("pos")))
    return rows.withColumn("_r", keep).where("_r = 1").drop("_r")


def dup_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("file").agg(F.count("*").alias("items"), (F.count("*") - F.countDistinct("id")).alias("dups"))


def url_range_dedup(rows: DataFrame, lo: int, hi: int) -> DataFrame:
    """Rows (url, fp, seq) of a range of host hashes, the first of each URL."""
    some = rows.where(F.col("fp").between(lo, hi))
    return some.groupBy("url").agg(F.min_by(F.struct(*[c for c in rows.columns if c != "url"]), "seq").alias("r")).select("url", "r.*")
