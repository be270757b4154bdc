"""Jobs, servers and their relations, as small tables.

Tables: jobs (name, wscl array<int>, changed), server_jobs (server, job, ts),
job_servers (job, svid, name), servers (name, ts).
"""

from __future__ import annotations

import re

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.schemas import JOBS, WORKSETS

DAY, TEN_MINUTES = 86_400, 600


def valid_name(name: Column) -> Column:
    """A name that a submission may use: a letter, then letters and digits."""
    return name.rlike("^[a-zA-Z][a-zA-Z0-9]*$")


def can_create(name: str) -> bool:
    """A new job's name has two characters at least."""
    return re.fullmatch("[a-zA-Z][a-zA-Z0-9]+", name) is not None


def create_job(spark: SparkSession, jobs: DataFrame, name: str, clients: int = 1, worksets: int = WORKSETS, now: int = 0) -> DataFrame:
    """``jobs`` with a new one, whose worksets are dealt to the clients in turn."""
    if not can_create(name):
        raise ValueError(f"{name!r} is no name for a job")
    if clients < 1:
        raise ValueError("a job needs a client")
    if exists(jobs, name):
        raise ValueError(f"job {name} exists")
    new = spark.range(1).select(F.lit(name).alias("name"), F.transform(F.sequence(F.lit(0), F.lit(worksets - 1)), lambda i: (i % clients).cast("int")).alias("wscl"), F.lit(now).cast("long").alias("changed"))
    return jobs.select("name", "wscl", "changed").unionByName(new)


def exists(jobs: DataFrame, name: str) -> bool:
    return bool(jobs.where(F.col("name") == name).limit(1).count())


def get_job(jobs: DataFrame, name: str) -> DataFrame:
    """(ws, client) of a job; an unknown job is an error."""
    if not exists(jobs, name):
        raise KeyError(name)
    return jobs.where(F.col("name") == name).select(F.posexplode("wscl").alias("ws", "client"))


def save_job(jobs: DataFrame, changed: DataFrame) -> DataFrame:
    """Upsert by name: the latest change of each job."""
    both = jobs.unionByName(changed)
    return both.groupBy("name").agg(F.max_by(F.struct("wscl", "changed"), "changed").alias("j")).select("name", "j.*")


def delete_jobs(jobs: DataFrame, names: list[str]) -> DataFrame:
    return jobs.where(~F.col("name").isin(names))


def write_snapshot(jobs: DataFrame, path: str) -> None:
    """Keep a copy in JSON for when the store of jobs can't be read."""
    jobs.coalesce(1).write.mode("overwrite").json(path)


def load_jobs(spark: SparkSession, read, snapshot: str) -> DataFrame:
    """Jobs of the store that ``read`` opens, which renews the snapshot; if the store can't be
    read, those of the snapshot."""
    try:
        jobs = read()
        write_snapshot(jobs.select("name", "wscl", "changed"), snapshot)
        return jobs
    except (PySparkException, OSError):
        return spark.read.schema(JOBS).json(snapshot)


def active_jobs(server_jobs: DataFrame, now: int, within: int = DAY) -> DataFrame:
    """Jobs that a server published within a day."""
    return server_jobs.where(F.col("ts") > now - within)


def publish_job(server_jobs: DataFrame, server: str, job: str, now: int) -> DataFrame:
    """``server_jobs`` with a job's new time, unless it was published within ten minutes."""
    mine = (F.col("server") == server) & (F.col("job") == job)
    if server_jobs.where(mine & (F.col("ts") > now - TEN_MINUTES)).limit(1).count():
        return server_jobs
    new = server_jobs.sparkSession.createDataFrame([(server, job, now)], "server string, job string, ts long")
    return server_jobs.where(~mine).unionByName(new)


def publish_alive(servers: DataFrame, name: str, now: int) -> DataFrame:
    """``servers`` (name, ts) with the latest time of each."""
    new = servers.sparkSession.createDataFrame([(name, now)], "name string, ts long")
    return servers.unionByName(new).groupBy("name").agg(F.max("ts").alias("ts"))


def add_job_server(registered: DataFrame, job: str, name: str) -> DataFrame:
    """``registered`` (job, svid, name) with a server under the job's next number."""
    new = registered.where(F.col("job") == job).agg(
        F.lit(job).alias("job"), (F.coalesce(F.max("svid"), F.lit(-1)) + 1).alias("svid"), F.lit(name).alias("name"))
    known = registered.where(F.col("job") == job).select("name")
    return registered.unionByName(new.join(known, "name", "left_anti").select(*registered.columns))


def delete_job_servers(server_jobs: DataFrame, asked: DataFrame, now: int, within: int = DAY) -> tuple[DataFrame, DataFrame]:
    """``server_jobs`` without the rows ``asked`` for (server, job), and (server, job, success):
    a server that published the job within a day stays."""
    busy = server_jobs.where(F.col("ts") > now - within).select("server", "job").distinct().withColumn("_busy", F.lit(True))
    known = server_jobs.select("server", "job").distinct().withColumn("_known", F.lit(True))
    judged = asked.select("server", "job").distinct().join(known, ["server", "job"], "left").join(busy, ["server", "job"], "left")
    judged = judged.select("server", "job", (F.col("_known").isNotNull() & F.col("_busy").isNull()).alias("success"))
    return server_jobs.join(judged.where("success"), ["server", "job"], "left_anti"), judged


def group_rows(rows: DataFrame, worksets: DataFrame) -> DataFrame:
    """Rows whose workset is in ``worksets`` (ws)."""
    return rows.join(F.broadcast(worksets.select("ws").distinct()), "ws", "left_semi")


def nocrawl_seeds(seeds: DataFrame) -> DataFrame:
    """URLs of seeds (url, nocrawl.active) that are not to be crawled."""
    return seeds.where("nocrawl.active = 1").select(F.concat(F.lit("http://"), "url").alias("u"))
