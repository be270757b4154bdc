"""Worksets, clients and servers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions import fingerprint as fp
from spindrift.functions import urls
from spindrift.schemas import WORKSETS


def with_workset(rows: DataFrame, url: str = "u", bits: int = fp.WORKSET_BITS, rules: list[tuple[str, str]] | None = None) -> DataFrame:
    """Append ``prefix`` and ``ws``; null URLs have neither. Only the prefix goes through Python."""
    return rows.drop("ws").withColumn("prefix", urls.domain_prefix(F.col(url), rules)).withColumn("ws", fp.workset("prefix", bits))


def default_wscl(spark: SparkSession, clients: int, worksets: int = WORKSETS) -> DataFrame:
    """(ws, client) rows that deal worksets out in turn."""
    if clients < 1:
        raise ValueError("a job needs a client")
    return spark.range(worksets).select(F.col("id").cast("int").alias("ws"), (F.col("id") % clients).cast("int").alias("client"))


def valid_wscl(jobs: DataFrame, worksets: int = WORKSETS) -> DataFrame:
    """Jobs (name, wscl) whose assignment has an entry per workset, with the client count."""
    return jobs.where(F.size("wscl") == worksets).withColumn("clients", F.array_max("wscl") + 1)


def explode_wscl(jobs: DataFrame) -> DataFrame:
    return jobs.select("name", F.posexplode("wscl").alias("ws", "client"))


def client_worksets(wscl: DataFrame) -> DataFrame:
    return wscl.groupBy("client").agg(F.sort_array(F.collect_list("ws")).alias("worksets"))


def server_of(ws: Column, servers: int) -> Column:
    """Server of a workset of 25 groups."""
    return F.floor((ws % 25) / servers).cast("int")


def server_clients(clients: DataFrame, servers: int) -> DataFrame:
    """Contiguous slices of clients: (server, client)."""
    n = clients.agg(F.count("*").alias("n"))
    width = F.ceil(F.col("n") / servers)
    return clients.join(F.broadcast(n)).select(F.floor(F.col("client") / width).cast("int").alias("server"), "client")


def distribute(rows: DataFrame, wscl: DataFrame, servers: int) -> DataFrame:
    """Discovered rows with the client and server that own them. No row moves here: a sink
    that wants a server's rows together repartitions by ``server``."""
    owned = with_workset(rows).join(F.broadcast(wscl), "ws")
    return owned.withColumn("server", server_of(F.col("ws"), servers))


def channels(owned: DataFrame, servers: int, files: int = 1) -> DataFrame:
    """Rows of :func:`distribute` dealt to ``files`` partitions of each server, so that a
    server with most of the rows is not one task."""
    salted = owned.withColumn("_salt", F.pmod(F.xxhash64("u"), F.lit(files)))
    return salted.repartition(servers * files, "server", "_salt").drop("_salt")


def locate(rows: DataFrame, wscl: DataFrame, servers: DataFrame, n_servers: int) -> DataFrame:
    """Workset, client and server (server, name) of URLs; name is null for a server that is not there."""
    placed = with_workset(rows.withColumn("u", urls.with_default_scheme(F.col("u")))).join(F.broadcast(wscl), "ws", "left")
    return placed.withColumn("server", server_of(F.col("ws"), n_servers)).join(F.broadcast(servers), "server", "left")


def shuffle_targets(diverted: DataFrame, me: int, alive: DataFrame, servers: int) -> DataFrame:
    """Diverted rows (ws) that go to another, living server."""
    return diverted.withColumn("server", server_of(F.col("ws"), servers)).where(F.col("server") != me).join(alive, "server", "left_semi")
