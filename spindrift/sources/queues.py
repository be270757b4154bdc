"""Queue directories: segments, streams, and sinks by priority, workset and key window.

A directory holds segments named by the time they were begun, which begin with a digit from
1 to 9; a segment that is still written ends in ``.open``. Order is the order of names, then
of places in a segment; both are columns here, since nothing else keeps order in Spark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions.urls import priority
from spindrift.operators import seen
from spindrift.schemas import CURI
from spindrift.sources.formats import parse_queue_lines

GLOB = "[1-9]*"
#: Rows of a file beyond which a sink begins the next one.
ROLL_ROWS = 5_000_000


def segments(spark: SparkSession, path: str, taken: DataFrame | None = None) -> DataFrame:
    """Closed segments of a directory and its ``prio=`` and ``ws=`` folders: file, path, bytes,
    and prio; without those in ``taken`` (file), and without empty ones. No content is read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", GLOB).option("recursiveFileLookup", "true").load(path)
    found = found.select(F.element_at(F.split("path", "/"), -1).alias("file"), "path", F.col("length").alias("bytes"))
    found = found.withColumn("prio", F.regexp_extract("path", "/prio=([0-9]+)/", 1).try_cast("int")).where(~F.col("file").endswith(".open"))
    return found if taken is None else found.join(taken.select("file"), "file", "left_anti")


def next_segment(spark: SparkSession, path: str, taken: DataFrame | None = None) -> str | None:
    """The path of the next segment that has content: least priority, then least name."""
    first = segments(spark, path, taken).agg(F.min_by("path", F.struct(F.coalesce("prio", F.lit(0)), "file"))).first()
    return first[0]


def priorities(spark: SparkSession, path: str) -> DataFrame:
    """Priorities that have a segment, with the number of segments and bytes of each."""
    return queue_stats(spark, path).where("prio is not null").orderBy("prio")


def queue_stats(spark: SparkSession, path: str) -> DataFrame:
    """Segments and bytes by priority; null for a directory without priorities."""
    return segments(spark, path).groupBy("prio").agg(F.count("*").alias("segments"), F.sum("bytes").alias("bytes"))


def _lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    read = spark.read.option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").text(paths)
    return read.select("value", F.col("_metadata.file_name").alias("file"), F.regexp_extract("_metadata.file_path", "/prio=([0-9]+)/", 1).try_cast("int").alias("prio"),
                       F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))


def read_segments(spark: SparkSession, paths: list[str], schema: str = CURI) -> DataFrame:
    """Live rows of segments with their place: prio, file and pos, which grows within a file."""
    r = F.from_json(F.expr("substring(value, 2)"), schema).alias("r")
    rows = _lines(spark, paths).where(F.substring("value", 1, 1) == " ")
    # a task reads a block of a file from its start, so that lines grow within a block
    return rows.select("prio", "file", F.struct("block", "line").alias("pos"), r).where("r.u is not null").select("prio", "file", "pos", "r.*")


def read_directory(spark: SparkSession, path: str, taken: DataFrame | None = None, schema: str = CURI) -> DataFrame:
    """All live rows of a directory's closed segments; list names on the driver, rows stay out of it."""
    paths = [r.path for r in segments(spark, path, taken).select("path").collect()]
    return read_segments(spark, paths, schema) if paths else spark.createDataFrame([], f"prio INT, file STRING, pos STRUCT<block: BIGINT, line: BIGINT>, {schema}")


def bulk_read(spark: SparkSession, path: str, taken: DataFrame | None = None, schema: str = CURI) -> DataFrame:
    """The rows of exactly one segment, the next; none if there is none."""
    first = next_segment(spark, path, taken)
    return read_directory(spark, path, taken, schema).limit(0) if first is None else read_segments(spark, [first], schema)


def stream_queue(spark: SparkSession, path: str, schema: str = CURI, files: int = 1, max_bytes: str | None = None, clean: str = "off", archive: str | None = None) -> DataFrame:
    """The rows of a directory as a stream, oldest segments first.

    A batch takes ``files`` segments, or segments up to ``max_bytes``. Read segments stay,
    or go (``clean="delete"``), or move to ``archive``; the checkpoint knows them anyway.
    """
    read = spark.readStream.option("pathGlobFilter", GLOB).option("latestFirst", "false").option("ignoreCorruptFiles", "true").option("cleanSource", clean)
    read = read.option("maxBytesPerTrigger", max_bytes) if max_bytes else read.option("maxFilesPerTrigger", files)
    lines = (read.option("sourceArchiveDir", archive) if archive else read).text(path)
    return parse_queue_lines(lines.where(~F.col("_metadata.file_name").endswith(".open")), schema)


def _write(rows: DataFrame, path: str, by: list[str], codec: str, mode: str = "append") -> None:
    body = [c for c in rows.columns if c not in by]
    lines = rows.select(*by, F.concat(F.lit(" "), F.to_json(F.struct(*body))).alias("value"))
    writer = lines.write.mode(mode).option("compression", codec).option("maxRecordsPerFile", ROLL_ROWS)
    (writer.partitionBy(*by) if by else writer).text(path)


def write_priority(rows: DataFrame, path: str, of=priority, files: int = 1) -> None:
    """Rows into a folder for each priority; ``of`` gives the priority of a hop path column.
    Each priority is written by ``files`` tasks."""
    placed = rows.withColumn("prio", of(F.col("p")))
    _write(placed.repartition(files * 4, "prio", F.pmod(F.xxhash64("u"), F.lit(files))), path, ["prio"], "gzip")


def write_worksets(rows: DataFrame, path: str, files: int = 1, mode: str = "append") -> None:
    """Rows into a folder for each workset, uncompressed. A workset is written by ``files`` tasks."""
    _write(rows.repartition("ws", F.pmod(F.xxhash64("u"), F.lit(files))), path, ["ws"], "none", mode)


def write_diverted(rows: DataFrame, path: str, names: Column) -> None:
    """Rows into a folder for each of the names that ``names`` (an array) gives them."""
    _write(rows.withColumn("name", F.explode(names)).repartition("name", F.pmod(F.xxhash64("u"), F.lit(4))), path, ["name"], "gzip")


def write_excluded(rows: DataFrame, path: str) -> None:
    _write(rows, path, [], "gzip")


def write_pooled(rows: DataFrame, path: str, n: int) -> None:
    """Rows into n files of about equal numbers."""
    _write(rows.repartition(n), path, [], "gzip")


def write_windows(rows: DataFrame, path: str) -> None:
    """Rows (id) into a folder for each of the 1024 windows of keys."""
    _write(seen.id_window(rows).repartitionByRange("win", "id"), path, ["win"], "gzip")


def split(rows: DataFrame, path: str, splitter: Column) -> None:
    """Rows into a folder for each value of ``splitter``."""
    _write(rows.withColumn("part", splitter), path, ["part"], "gzip")


def rewrite_sorted(spark: SparkSession, source: str, target: str, schema: str) -> None:
    """Segments as one sorted set: the last row of each id, ordered by id across files."""
    rows = read_directory(spark, source, schema=schema)
    last = rows.groupBy("id").agg(F.max_by(F.struct(*[c for c in rows.columns if c not in ("id", "prio", "file", "pos")]), F.struct("file", "pos")).alias("r"))
    _write(last.select("id", "r.*").repartitionByRange("id").sortWithinPartitions("id"), target, [], "gzip")


class IncomingQueue:
    """A queue directory that counts what is added and reads what is closed."""

    def __init__(self, spark: SparkSession, path: str, schema: str = CURI):
        self.spark, self.path, self.schema = spark, path, schema

    def add(self, rows: DataFrame) -> int:
        """Append rows; their number. They are readable at once: a Spark write closes its files."""
        _write(rows, self.path, [], "gzip")
        return rows.count()

    def get(self, taken: DataFrame | None = None) -> DataFrame:
        return bulk_read(self.spark, self.path, taken, self.schema)

    def status(self) -> DataFrame:
        return queue_stats(self.spark, self.path)

