"""Frontier inputs derived from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HOPS = ["", "R", "E", "I", "L", "LL", "LR"]
DOMAINS = [("spam-farm.example.org", 1), ("cheap-pills.example.com", 1), ("example.net", 0), ("ththre.example.com", 1), ("example.org", 0)]
CLIENTS, SERVERS = 20, 5


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def pages(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").select("page_id", "url")
    return p.select(F.col("page_id").alias("seq"), F.col("url").alias("u"),
                    F.element_at(F.array(*map(F.lit, HOPS)), (F.col("page_id") % 7 + 1).cast("int")).alias("p"),
                    (F.col("page_id") % 11 == 0).cast("int").alias("f"))


def links(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").select("page_id", "url", F.posexplode(F.expr("regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)")).alias("pos", "href"))
    origin = F.regexp_extract("url", "^([a-z]+://[^/]+)", 1)
    u = F.when(F.col("href").rlike("^[a-z]+:"), F.col("href")).when(F.col("href").startswith("/"), F.concat(origin, "href")).otherwise(F.concat(origin, F.lit("/"), "href"))
    return p.select((F.col("page_id") * 10000 + F.col("pos")).alias("seq"), u.alias("u"), F.col("url").alias("v"))


def wide(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("seq"), F.concat(F.lit("http://www.c"), F.col("c_custkey").cast("string"), F.lit(".com/")).alias("u"))


def bulk(spark: SparkSession, d: str) -> DataFrame:
    """A URL per line item: many rows, each order of a part once or more."""
    return table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
        F.concat(F.lit("http://p"), (F.col("l_partkey") % 5000).cast("string"), F.lit(".com/o/"), (F.col("l_orderkey") % 40000).cast("string")).alias("u"),
        F.when(F.col("l_linenumber") == 7, 1).otherwise(0).alias("f"))


def registered(spark: SparkSession, d: str) -> DataFrame:
    """Servers (job, svid, name) from the nations of regions."""
    n = table(spark, d, "nation").where("n_nationkey % 4 <> 0")
    return n.select(F.concat(F.lit("job"), F.col("n_regionkey").cast("string")).alias("job"), F.col("n_nationkey").cast("int").alias("svid"), F.lower("n_name").alias("name"))


def server_jobs(spark: SparkSession, d: str) -> DataFrame:
    """Publications (server, job, ts): a supplier's server and the job of its nation, within 100,000 seconds."""
    return table(spark, d, "supplier").select(F.concat(F.lit("s"), (F.col("s_suppkey") % 40).cast("string")).alias("server"),
        F.concat(F.lit("job"), (F.col("s_nationkey") % 5).cast("string")).alias("job"), (F.col("s_suppkey") * 15013 % 100000).cast("long").alias("ts"))


def jobs(spark: SparkSession, d: str) -> DataFrame:
    """A job per region, with one client more than its number."""
    r = table(spark, d, "region")
    wscl = F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: (i % (F.col("r_regionkey") + 1)).cast("int"))
    return r.select(F.lower("r_name").alias("name"), wscl.alias("wscl"), F.col("r_regionkey").cast("long").alias("changed"))


def activity(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy((F.col("user_id") % CLIENTS).cast("int").alias("client")).agg(F.max("ts").alias("last_feed"))


def domains(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DOMAINS, "domain string, exclude int")


#: The same inputs as SQL for the oracles.
SQL = {
    "pg": "pg AS (SELECT page_id AS seq, url AS u, (['', 'R', 'E', 'I', 'L', 'LL', 'LR'])[page_id % 7 + 1] AS p, (page_id % 11 = 0)::INT AS f FROM pages)",
    "lk": """hr AS (SELECT page_id, url, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href, generate_subscripts(regexp_extract_all(html, 'href="([^"]*)"', 1), 1) - 1 AS pos FROM pages),
lk AS (SELECT page_id * 10000 + pos AS seq, CASE WHEN regexp_matches(href, '^[a-z]+:') THEN href WHEN starts_with(href, '/') THEN regexp_extract(url, '^([a-z]+://[^/]+)', 1) || href ELSE regexp_extract(url, '^([a-z]+://[^/]+)', 1) || '/' || href END AS u, url AS v FROM hr)""",
    "wd": "wd AS (SELECT c_custkey AS seq, 'http://www.c' || c_custkey || '.com/' AS u FROM customer)",
    "bk": "bk AS (SELECT l_orderkey * 10 + l_linenumber AS seq, 'http://p' || l_partkey % 5000 || '.com/o/' || l_orderkey % 40000 AS u, (l_linenumber = 7)::INT AS f FROM lineitem)",
    "rg": "rg AS (SELECT 'job' || n_regionkey AS job, n_nationkey::INT AS svid, lower(n_name) AS name FROM nation WHERE n_nationkey % 4 <> 0)",
    "sj": "sj AS (SELECT 's' || s_suppkey % 40 AS server, 'job' || s_nationkey % 5 AS job, (s_suppkey * 15013 % 100000)::BIGINT AS ts FROM supplier)",
    "jb": "jb AS (SELECT lower(r_name) AS name, i::INT AS ws, (i % (r_regionkey + 1))::INT AS client, r_regionkey::BIGINT AS changed FROM region, range(256) t(i))",
    "ac": f"ac AS (SELECT (user_id % {CLIENTS})::INT AS client, max(ts) AS last_feed FROM events GROUP BY 1)",
    "dm": "dm AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', {b})" for a, b in DOMAINS) + ") AS t(domain, exclude))",
}
