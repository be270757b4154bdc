"""The seen check as keyed state of a stream: per id, the time until which it counts as seen."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from spindrift.functions.fingerprint import frontier_id
from spindrift.schemas import NEVER

OUT = "id long, seq long, u string"
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class SeenProcessor(StatefulProcessor):
    """Passes the first row of an id by ``seq``, and again once its expiry has passed; forced
    rows pass always and change nothing."""

    def __init__(self, now: int):
        self.now = now

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.expiry = handle.getValueState("expiry", "e long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best, forced = None, []
        for part in rows:  # rows of a key come in several parts, in no order
            free = part[part["f"] == 0]
            if len(free):
                low = free.loc[free["seq"].idxmin()]
                best = low if best is None or low["seq"] < best["seq"] else best
            forced.append(part[part["f"] != 0])
        out = [x[["seq", "u"]] for x in forced if len(x)]
        if best is not None:
            known = self.expiry.get()[0] if self.expiry.exists() else 0
            if known < self.now:
                out.append(pd.DataFrame({"seq": [best["seq"]], "u": [best["u"]]}))
                self.expiry.update((NEVER,))
        if out:
            yield pd.concat(out).assign(id=key[0])[["id", "seq", "u"]]

    def close(self) -> None:
        pass


def check(stream: DataFrame, now: int) -> DataFrame:
    """Rows (seq, u, f) of a stream that pass; the state lives in the query's checkpoint."""
    rows = stream.select(frontier_id("u").alias("id"), "seq", "u", "f")
    return rows.groupBy("id").transformWithStateInPandas(SeenProcessor(now), OUT, "Append", "None")


def run(spark: SparkSession, source: str, root: str, schema: str, now: int, files_per_batch: int = 1) -> DataFrame:
    """Check all files that are there, and end."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
        query = check(stream, now).writeStream.option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start(path=f"{root}/passed", format="parquet")
        query.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.schema(OUT).parquet(f"{root}/passed")
