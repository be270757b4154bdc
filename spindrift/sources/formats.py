"""Readers and writers of the frontier's text and binary formats."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.schemas import CURI

RECORD_BYTES = 12
#: Bytes of a seen file that one task reads whole.
WHOLE_BYTES = 1 << 29


def queue_lines(rows: DataFrame) -> DataFrame:
    """One live line per row: a blank and compact JSON."""
    return rows.select(F.concat(F.lit(" "), F.to_json(F.struct("*"))).alias("value"))


def write_queue(rows: DataFrame, path: str, by: list[str] | None = None, codec: str = "gzip") -> None:
    out = queue_lines(rows.drop(*(by or [])))
    if by:
        out = rows.select(*by, F.concat(F.lit(" "), F.to_json(F.struct(*[c for c in rows.columns if c not in by]))).alias("value"))
    writer = out.write.option("compression", codec)
    (writer.partitionBy(*by) if by else writer).text(path)


def parse_queue_lines(lines: DataFrame, schema: str = CURI) -> DataFrame:
    """Rows of live lines (state byte blank); consumed and malformed lines go, as do rows without u."""
    r = F.from_json(F.expr("substring(value, 2)"), schema)
    return lines.where(F.substring("value", 1, 1) == " ").select(r.alias("r")).where("r.u is not null").select("r.*")


def read_queue(spark: SparkSession, path: str, glob: str = "*", schema: str = CURI) -> DataFrame:
    """A queue directory; damaged compressed files give their readable part."""
    return parse_queue_lines(spark.read.option("pathGlobFilter", glob).option("ignoreCorruptFiles", "true").text(path), schema)


def parse_seeds(lines: DataFrame) -> DataFrame:
    """Seed lines: comments and blanks go, bare hosts become URLs; the hop path is empty."""
    v = F.trim("value")
    return lines.where((v != "") & ~v.startswith("#")).select(
        F.when(v.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), v).otherwise(F.concat(F.lit("http://"), v, F.lit("/"))).alias("u"), F.lit("").alias("p"))


def parse_divert(lines: DataFrame) -> DataFrame:
    f = F.split(F.trim("value"), r"\s+")
    return lines.where((F.size(f) >= 5) & (F.get(f, F.lit(1)) == "CrawlURI")).select(*(F.get(f, F.lit(i)).alias(n) for i, n in ((2, "u"), (3, "p"), (4, "v"))))


def parse_uvpx(lines: DataFrame) -> DataFrame:
    """Exactly four fields u v p x; the word null stands for none."""
    f = F.split(F.trim("value"), r"\s+")
    return lines.where(F.size(f) == 4).select(*(F.nullif(F.get(f, F.lit(i)), F.lit("null")).alias(n) for i, n in enumerate("uvpx")))


def parse_requeue(lines: DataFrame) -> DataFrame:
    """Queue lines for import: p, v, x of ``a``, overridden by those of ``w``."""
    t = F.ltrim("value")
    r = F.from_json(t, CURI)
    rows = lines.where(~F.col("value").startswith("#") & t.startswith("{")).select(r.alias("r")).where("r.u is not null")
    return rows.select("r.u", *(F.coalesce(F.col(f"r.w.{k}"), F.col(f"r.a.{k}")).alias(k) for k in "pvx"))


def parse_crawl_log(lines: DataFrame) -> DataFrame:
    """Crawl-log lines of 11 fields or more: url and result; failures, robots and DNS go."""
    f = F.split(F.trim("value"), r"\s+")
    g = lambda i: F.get(f, F.lit(i))
    m = F.unix_timestamp(F.try_to_timestamp(F.substring(g(8), 1, 14), F.lit("yyyyMMddHHmmss")))
    x = lines.where(F.size(f) >= 11).select(g(3).alias("u"), g(1).try_cast("int").alias("s"), g(2).alias("_size"), F.nullif(g(9), F.lit("-")).alias("d"), m.alias("m"))
    return x.where((F.col("s") > 0) & (F.col("_size") != "-") & ~F.col("u").endswith("/robots.txt") & ~F.col("u").startswith("dns:")).drop("_size")


def pack_seen(rows: DataFrame) -> Column:
    """Little-endian 12-byte record of (key, ts) as a column of built-in functions."""
    def le(c: Column, n: int) -> Column:
        h = F.lpad(F.hex(c), 16, "0")
        return F.concat(*(F.substring(h, 15 - 2 * i, 2) for i in range(n)))

    return F.unhex(F.concat(le(rows["key"].cast("long"), 8), le(rows["ts"].cast("long"), 4)))


def read_seen(spark: SparkSession, path: str, version: int = 2) -> DataFrame:
    """Binary seen files: 12-byte records (key, ts) of version 2, or 8-byte keys of version 1,
    whose ts is 0. A short last record is dropped. Files up to WHOLE_BYTES are a row each;
    larger ones, which must hold whole records, are split at records."""
    size = RECORD_BYTES if version == 2 else 8

    def joined(records: Iterator[bytes]) -> Iterator[tuple[bytes]]:
        while block := b"".join(islice(records, 1_000_000)):
            yield (block,)

    files = spark.read.format("binaryFile").load(path)
    content = files.where(F.col("length") <= WHOLE_BYTES).select("content")
    large = [r.path for r in files.where(F.col("length") > WHOLE_BYTES).select("path").collect()]
    for p in large:
        blocks = spark.sparkContext.binaryRecords(p, size).mapPartitions(joined)
        content = content.union(spark.createDataFrame(blocks, "content binary"))
    return content.mapInArrow(records_of if version == 2 else _keys_of, "key long, ts long")


def _records(batches: Iterator[pa.RecordBatch], kind: np.dtype) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for x in b.column(0):
            raw = x.as_buffer()
            found = np.frombuffer(raw, kind, raw.size // kind.itemsize)
            for at in range(0, len(found), 1_000_000):
                part = found[at : at + 1_000_000]
                ts = part["ts"].astype(np.int64) if "ts" in kind.names else np.zeros(len(part), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(part["key"].copy()), pa.array(ts)], ["key", "ts"])


def records_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records (key, ts) of binary content, for ``mapInArrow``; a short last one is dropped."""
    return _records(batches, np.dtype([("key", "<i8"), ("ts", "<u4")]))


def _keys_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _records(batches, np.dtype([("key", "<i8")]))


def write_seen_text(seen: DataFrame, path: str) -> None:
    """All keys in order, one decimal number a line."""
    seen.select("key").repartitionByRange("key").sortWithinPartitions("key").select(F.col("key").cast("string").alias("value")).write.text(path)


def dump_seen(seen: DataFrame, records: int = 1_000_000) -> DataFrame:
    """The seen set as binary content: rows (first, n, content) of about ``records`` records in
    key order, the greatest key of a row below the least of the next."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.zeros(b.num_rows, np.dtype([("key", "<i8"), ("ts", "<u4")]))
            out["key"], out["ts"] = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for at in range(0, len(out), records):
                part = out[at : at + records]
                yield pa.RecordBatch.from_pydict({"first": [int(part["key"][0])], "n": [len(part)], "content": [part.tobytes()]})

    return seen.select("key", F.col("ts").cast("long")).repartitionByRange("key").sortWithinPartitions("key").mapInArrow(run, "first long, n long, content binary")


def pack_modified(m: Column) -> Column:
    """Eight bytes, the highest first."""
    return F.unhex(F.lpad(F.hex(m), 16, "0"))


def unpack_modified(content: Column) -> Column:
    """The number of eight bytes, the highest first; null for other lengths."""
    digits = F.conv(F.hex(content), 16, 10).cast("decimal(20,0)")
    number = F.when(digits >= F.lit(str(2**63)).cast("decimal(20,0)"), digits - F.lit(str(2**64)).cast("decimal(20,0)")).otherwise(digits)
    return F.when(F.octet_length(content) == 8, number.cast("long"))


def parse_discovered(lines: DataFrame) -> DataFrame:
    """Bodies of submissions, one a line: a list of rows, or ``{"f": 1, "u": [rows]}``, whose
    rows are all forced; a row may be a bare URL. Rows without URL go, as do bodies that are neither."""
    t = F.trim("value")
    listed = t.startswith("[")
    body = F.from_json(F.when(~listed, t), "f INT, u ARRAY<STRING>")
    items = F.from_json(F.when(listed, t), "ARRAY<STRING>")
    # array items are read as text, each then as a row or a bare URL
    x = lines.select(F.coalesce(body["f"], F.lit(0)).alias("_f"), F.explode(F.coalesce(items, body["u"])).alias("_item"))
    row = F.from_json(F.when(F.col("_item").startswith("{"), F.col("_item")), "u STRING, p STRING, v STRING, x STRING, f INT")
    x = x.select("_f", "_item", row.alias("r"))
    u = F.when(F.col("_item").startswith("{"), F.col("r.u")).otherwise(F.col("_item"))
    f = F.greatest(F.col("_f"), F.coalesce("r.f", F.lit(0)))
    return x.select(u.alias("u"), "r.p", "r.v", "r.x", f.alias("f")).where("u is not null and u <> ''")


def recovered_positions(journal: DataFrame, rows: int) -> DataFrame:
    """Places (pos) that a journal's lines name; lines that name none, or one out of range, go."""
    return journal.select(F.trim("value").try_cast("long").alias("pos")).where((F.col("pos") >= 0) & (F.col("pos") < rows))


def json_lines(rows: DataFrame) -> DataFrame:
    """Each row as one JSON object."""
    return rows.select(F.to_json(F.struct("*")).alias("value"))


def parse_bool(text: Column) -> Column:
    n = text.try_cast("int")
    return F.when(F.lower(text) == "true", True).when(F.lower(text) == "false", False).when(n.isNotNull(), n != 0).otherwise(F.coalesce(text, F.lit("")) != "")
