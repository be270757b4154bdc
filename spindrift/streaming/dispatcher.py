"""Micro-batch dispatch over queue directories, with a seen set of deltas.

Batch n reads the seen set as of n, which is a base and the deltas of the batches since, and
writes, under its own number, what it schedules, saves and excludes, its counters, and last
its delta of new keys, whose success mark is the commit point. A replayed batch overwrites
what it wrote, so that a failure in between loses and repeats nothing. The seen set is never
rewritten for a batch: every ``COMPACT`` batches the deltas become the next base.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions.fingerprint import frontier_id
from spindrift.operators import dispatch
from spindrift.operators.dispatch import first_per_key

#: Batches between two bases, and keys of a batch up to which they are broadcast to the seen set.
COMPACT, BROADCAST_KEYS = 20, 2_000_000
_SEEN = "key long, ts long"


def _fs(spark: SparkSession, path: str):
    """Path and file system of a path, in the JVM."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def drop(spark: SparkSession, path: str) -> None:
    p, fs = _fs(spark, path)
    fs.delete(p, True)


def files_of(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """(folder, name) of the data files under a folder, in order."""
    p, fs = _fs(spark, path)
    out, it = [], fs.listFiles(p, True)
    while it.hasNext():
        f = it.next().getPath()
        if not str(f.getName()).startswith(("_", ".")):
            out.append((str(f.getParent()), str(f.getName())))
    return sorted(out)


def _versions(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the committed ``n=`` folders of a folder."""
    path, fs = _fs(spark, folder)
    if not fs.exists(path):
        return []
    names = [str(x.getPath().getName()) for x in fs.listStatus(path)]
    done = (n for n in names if n.startswith("n=") and fs.exists(_fs(spark, f"{folder}/{n}/_SUCCESS")[0]))
    return sorted(int(n[2:]) for n in done)


def seen_at(spark: SparkSession, root: str, version: int) -> DataFrame:
    """The seen set before batch ``version``: the last base up to it, and the deltas since."""
    base = max((v for v in _versions(spark, f"{root}/seen/base") if v <= version), default=None)
    paths = [] if base is None else [f"{root}/seen/base/n={base}"]
    paths += [f"{root}/seen/delta/n={v}" for v in _versions(spark, f"{root}/seen/delta") if (base or 0) <= v < version]
    return spark.read.schema(_SEEN).parquet(*paths) if paths else spark.createDataFrame([], _SEEN)


def compact(spark: SparkSession, root: str, version: int) -> None:
    """Make the base before batch ``version``, sorted by key; drop what no replay needs."""
    seen = seen_at(spark, root, version).repartitionByRange("key").sortWithinPartitions("key")
    bases = _versions(spark, f"{root}/seen/base")
    seen.write.mode("overwrite").parquet(f"{root}/seen/base/n={version}")
    kept = bases[-1] if bases else 0  # the base before stays until the next
    old = [f"{root}/seen/base/n={v}" for v in bases[:-1]] + [f"{root}/seen/delta/n={v}" for v in _versions(spark, f"{root}/seen/delta") if v < kept]
    for p in old:
        drop(spark, p)


def known_keys(rows: DataFrame, seen: DataFrame) -> DataFrame:
    """Those ids of ``rows`` (id) that are in ``seen`` (key). The seen set is scanned in place:
    the batch's ids go to it, as long as they are few enough to be broadcast."""
    ids = rows.select("id").distinct()
    small = ids.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    return seen.select(F.col("key").alias("id")).join(F.broadcast(ids) if small else ids, "id", "left_semi").distinct()


def dispatch_batch(batch: DataFrame, number: int, root: str, dims: Callable[[], dict[str, DataFrame]] | None = None, compact_every: int = COMPACT) -> None:
    """Dispatch one batch. ``dims`` gives wscl, active and info as they are now; without it,
    every row is a candidate."""
    spark = batch.sparkSession

    def write(rows: DataFrame, kind: str) -> DataFrame:
        path = f"{root}/{kind}/batch={number}"
        by_ws = rows.repartition("ws", F.pmod(F.xxhash64("u"), F.lit(8))).write.partitionBy("ws") if "ws" in rows.columns else rows.write
        by_ws.mode("overwrite").parquet(path)
        return spark.read.schema(rows.schema).parquet(path)

    if dims is None:
        rows = batch.withColumn("id", frontier_id("u"))
    else:
        now = dims()
        routed = dispatch.route(batch.where("u is not null"), now["wscl"], now["active"], now["info"])
        routed.write.mode("overwrite").parquet(f"{root}/routed/n={number}")  # routed once
        routed = spark.read.schema(routed.schema).parquet(f"{root}/routed/n={number}")
        write(routed.where("route = 'saved'"), "saved")
        write(routed.where("route = 'excluded'"), "excluded")
        rows = routed.where("route = 'candidate'")
    forced = F.coalesce("f", F.lit(0)) != 0 if "f" in rows.columns else F.lit(False)
    known = known_keys(rows, seen_at(spark, root, number))
    known.write.mode("overwrite").parquet(f"{root}/known/n={number}")
    known = spark.read.schema("id long").parquet(f"{root}/known/n={number}")
    fresh = first_per_key(rows.where(~forced)).join(known, "id", "left_anti").unionByName(rows.where(forced))
    done = write(fresh, "scheduled")
    if dims is not None:
        dispatch.counters(routed, known.withColumnRenamed("id", "key")).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{root}/counters/n={number}")
    new = done.select("id").distinct().join(known, "id", "left_anti").select(F.col("id").alias("key"), F.lit(0).cast("long").alias("ts"))
    new.write.mode("overwrite").parquet(f"{root}/seen/delta/n={number}")
    if (number + 1) % compact_every == 0:
        compact(spark, root, number + 1)


def run(spark: SparkSession, source: str, root: str, schema: str, files_per_batch: int = 1,
        dims: Callable[[], dict[str, DataFrame]] | None = None, max_bytes: str | None = None, compact_every: int = COMPACT) -> DataFrame:
    """Dispatch all files that are there, and end; state survives in ``root``. The tables of
    ``dims`` are read again for every batch."""
    read = spark.readStream.schema(schema)
    read = read.option("maxBytesPerTrigger", max_bytes) if max_bytes else read.option("maxFilesPerTrigger", files_per_batch)
    query = (
        read.parquet(source).writeStream.foreachBatch(lambda df, n: dispatch_batch(df, n, root, dims, compact_every))
        .option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.parquet(f"{root}/scheduled")


def reactivate(spark: SparkSession, root: str, wscl: DataFrame, activated: DataFrame, target: str) -> int:
    """Put the saved rows of activated clients back into the queue ``target``, with priority 0,
    and take their worksets' folders away; the number of rows."""
    from spindrift.operators import activation

    saved = spark.read.parquet(f"{root}/saved")
    back, _ = activation.reactivate(saved, wscl, activated)
    back.drop("batch").write.mode("append").parquet(target)
    n = back.count()
    mine = {r.ws for r in back.select("ws").distinct().collect()}  # worksets are 256 at most
    for folder in {f for f, _ in files_of(spark, f"{root}/saved") if int(f.rsplit("ws=", 1)[-1]) in mine}:
        drop(spark, folder)
    return n
