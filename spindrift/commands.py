"""Commands over files: ``python -m spindrift.commands NAME ARG...``; each is a function too.

Every function takes a session and paths, and returns a DataFrame: what was written, or a report.
"""

from __future__ import annotations

import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions import suffixes, urls
from spindrift.functions.fingerprint import frontier_id
from spindrift.operators import assignment, jobs, seen, status
from spindrift.schemas import CURI
from spindrift.sources import formats, queues

PARSERS = {"seed": formats.parse_seeds, "divert": formats.parse_divert, "uvpx": formats.parse_uvpx, "queue": formats.parse_requeue}


def _seen(spark: SparkSession, path: str, version: int = 2) -> DataFrame:
    return formats.read_seen(spark, path, version)


def _write_seen(records: DataFrame, path: str) -> DataFrame:
    """A seen table sorted by key; what is there now."""
    records.select("key", "ts").repartitionByRange("key").sortWithinPartitions("key").write.mode("errorifexists").parquet(path)
    return records.sparkSession.read.schema("key long, ts long").parquet(path).agg(F.count("*").alias("records"))


def schedule(spark: SparkSession, kind: str, source: str, queue: str, job: str = "job", force: bool = False) -> DataFrame:
    """Parse a file of seeds, diverted rows, uvpx rows or queue lines (plain or gzip), and add
    the rows with a known scheme to a queue; the report of the submission."""
    if kind not in PARSERS:
        raise ValueError(f"no format {kind!r}")
    if not spark.range(1).select(jobs.valid_name(F.lit(job))).first()[0]:
        raise ValueError(f"{job!r} is no name for a job")
    rows = PARSERS[kind](spark.read.text(source))
    ok = urls.scheme_ok(F.col("u"))
    out = rows.where(ok)
    queues.write_excluded(out.withColumn("f", F.lit(1)) if force else out, queue)
    return status.submission_report(rows, ok)


def shuffle(spark: SparkSession, diverted: str, target: str, me: int, alive: list[int], servers: int) -> DataFrame:
    """Diverted rows (u) to a folder for each living server that owns them; rows of each."""
    rows = assignment.with_workset(formats.read_queue(spark, diverted))
    living = spark.createDataFrame([(s,) for s in alive], "server int")
    moved = assignment.shuffle_targets(rows, me, living, servers).drop("prefix")
    queues.split(moved, target, F.col("server"))
    return moved.groupBy("server").agg(F.count("*").alias("rows"))


def sort(spark: SparkSession, source: str, target: str) -> DataFrame:
    """A queue as one sorted set, the last row of each id; segments of the new one."""
    queues.rewrite_sorted(spark, source, target, CURI)
    return spark.read.text(target).agg(F.count("*").alias("rows"))


def split(spark: SparkSession, source: str, target: str) -> DataFrame:
    """A queue by windows of its keys; rows of each window."""
    rows = formats.read_queue(spark, source)
    rows = rows.withColumn("id", F.coalesce("id", frontier_id("u")))
    queues.write_windows(rows, target)
    return seen.id_window(rows).groupBy("win").agg(F.count("*").alias("rows"))


def seen_check(spark: SparkSession, path: str, version: int = 2) -> DataFrame:
    """Integrity of a binary seen file, in the order of its records."""
    records = _seen(spark, path, version).withColumn("pos", F.monotonically_increasing_id())
    return seen.integrity(records)


def seen_convert(spark: SparkSession, path: str, target: str) -> DataFrame:
    """Keys of version 1 as a seen table, whose times are 0."""
    return _write_seen(seen.convert_v1(_seen(spark, path, 1)), target)


def seen_repair(spark: SparkSession, target: str, *paths: str) -> DataFrame:
    """One seen table of several files, with the latest record of each key."""
    return _write_seen(seen.repair(*(_seen(spark, p) for p in paths)), target)


def seen_dump(spark: SparkSession, path: str, target: str) -> DataFrame:
    """The keys of a seen file as text, in order."""
    formats.write_seen_text(_seen(spark, path), target)
    return spark.read.text(target).agg(F.count("*").alias("records"))


def seen_rebuild(spark: SparkSession, logs: str, target: str) -> DataFrame:
    """A seen table from crawl logs."""
    return _write_seen(seen.rebuild(formats.parse_crawl_log(spark.read.text(logs))), target)


def novelty(spark: SparkSession, queue: str) -> DataFrame:
    """Distinct keys among all rows of a queue."""
    return seen.novelty(formats.read_queue(spark, queue).withColumn("id", F.coalesce("id", frontier_id("u"))))


def hashes(spark: SparkSession, queue: str) -> DataFrame:
    """The keys of a queue's rows."""
    return formats.read_queue(spark, queue).select(F.coalesce("id", frontier_id("u")).alias("id"))


def public_suffixes(spark: SparkSession, rules: str) -> DataFrame:
    """The regular expression of a rule file."""
    lines = [r.value for r in spark.read.text(rules).collect()]
    return spark.createDataFrame([(suffixes.rule_pattern(suffixes.parse_rules("\n".join(lines))),)], "pattern string")


COMMANDS = {f.__name__.replace("_", "-"): f for f in (
    schedule, shuffle, sort, split, seen_check, seen_convert, seen_repair, seen_dump, seen_rebuild, novelty, hashes, public_suffixes)}


def main(args: list[str]) -> int:
    if not args or args[0] not in COMMANDS:
        print("usage: python -m spindrift.commands NAME ARG...\nnames:", *COMMANDS, file=sys.stderr)
        return 2
    spark = SparkSession.builder.getOrCreate()
    # numbers and lists may be given as JSON; what is not JSON is text
    given = []
    for a in args[1:]:
        try:
            given.append(json.loads(a))
        except ValueError:
            given.append(a)
    for line in formats.json_lines(COMMANDS[args[0]](spark, *given)).toLocalIterator():
        print(line.value)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
