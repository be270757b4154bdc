"""Query catalogue of the frontier, each with its SQL oracle where SQL can express it."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions import fingerprint as fp
from spindrift.functions import suffixes, urls
from spindrift.operators import assignment, dispatch, feed, jobs, seen, status
from spindrift.operators.domains import with_domain_info
from spindrift.plans import views as v
from spindrift.plans.views import SQL
from spindrift.schemas import NEVER
from spindrift.sources import formats
from spindrift.workers import ensure_importable

_queries: dict[str, Callable] = {}
_oracles: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        @functools.wraps(f)
        def shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
            ensure_importable(spark)
            return f(spark, sf_dir)

        _queries[f.__name__] = shipped
        if sql is not None:
            _oracles[f.__name__] = sql
        return f

    return add


def q(*parts: str, body: str) -> str:
    return "WITH " + ",\n".join(SQL.get(p, p) for p in parts) + "\n" + body


TB = fp.duck_tables()
PREFIXED = r"""px AS (SELECT *, regexp_replace(regexp_replace(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1), '^.*@', ''), ':[0-9]+$', '') AS h FROM {src}),
pr AS (SELECT * REPLACE (CASE WHEN regexp_matches(h, '^[-\w]+(\.[-\w]+)+$') AND NOT regexp_matches(h, '^\d+\.\d+\.\d+\.\d+')
  THEN array_to_string(r[1:coalesce(list_min(list_filter(ks, lambda k: list_contains({exc}, lower(array_to_string(r[1:k+1], ','))))),
    list_max(list_filter(ks, lambda k: k = 1 OR list_contains({nor}, lower(array_to_string(r[1:k], ','))) OR (k > 1 AND list_contains({wil}, lower(array_to_string(r[1:k-1], ','))))))) + 1], ',') || ','
  ELSE h END AS h) FROM (SELECT *, list_reverse(string_split(h, '.')) AS r, range(1, least(len(string_split(h, '.')) - 1, 5) + 1) AS ks FROM px))"""


def prefixed(src: str) -> str:
    lit = lambda kind: "[" + ", ".join(f"'{x}'" for x in suffixes.of_kind(kind)) + "]"
    return PREFIXED.format(src=src, exc=lit("exception"), nor=lit("normal"), wil=lit("wildcard"))


def worksets(src: str) -> str:
    return prefixed(src) + f",\nws AS (SELECT pr.*, {fp.duck_workset('pr.h')} AS ws FROM pr, tb)"


def ided(src: str, name: str = "ix") -> str:
    return f"{name} AS (SELECT {src}.*, {fp.duck_id(src + '.u')} AS id FROM {src}, tb)"


# scalars

@query(q("pg", TB, body=f"SELECT seq, u, {fp.duck_id('u')} AS id FROM pg, tb"))
def url_fingerprint(s, d):
    return v.pages(s, d).select("seq", "u", fp.frontier_id("u").alias("id"))


@query(q("pg", TB, body=f"SELECT seq, {fp.duck_id('u', charwise=True)} AS id16 FROM pg, tb"))
def fingerprint_charwise(s, d):
    return v.pages(s, d).select("seq", fp.fingerprint_charwise("u").alias("id16"))


# these hosts are under example.com, .net and .org: two labels are the registered domain
@query(q("pg", TB, r"hk AS (SELECT seq, array_to_string(list_reverse(string_split(regexp_extract(u, '^[a-z]+://([^/:?#]+)', 1), '.'))[1:2], ',') || ',' AS key FROM pg)",
         body=f"SELECT seq, (least(h, 18446744073709551616 - h) % 20)::INT AS bucket FROM (SELECT seq, {fp.duck_unsigned('key', charwise=True)}::HUGEINT AS h FROM hk, tb)"))
def legacy_bucket_map(s, d):
    return v.pages(s, d).select("seq", urls.legacy_bucket(urls.core_key(F.col("u")), 20).alias("bucket"))


@query(q("pg", "wd", "un AS (SELECT seq, u FROM pg UNION ALL SELECT seq, u FROM wd)", prefixed("un"), body="SELECT seq, u, h AS prefix FROM pr"))
def domain_prefix(s, d):
    rows = v.pages(s, d).select("seq", "u").unionByName(v.wide(s, d))
    return rows.select("seq", "u", urls.domain_prefix(F.col("u")).alias("prefix"))


# written for what the pages have: no user information, no spaces
SURT = r"""su AS (SELECT seq, lower(regexp_extract(u, '^([a-z]+://)', 1) || '(' || array_to_string(list_reverse(string_split(regexp_extract(u, '^[a-z]+://([^/:]*)', 1), '.')), ',') || ','
  || regexp_extract(u, '^[a-z]+://[^/:]*(:[0-9]+)?', 1) || ')' || regexp_extract(u, '^[a-z]+://[^/]*(/.*)?$', 1)) AS surt FROM pg)"""


@query(q("pg", SURT, body="SELECT seq, surt FROM su"))
def surt_form(s, d):
    return v.pages(s, d).select("seq", urls.surt_form(F.col("u")).alias("surt"))


@query(q("pg", SURT, body="SELECT seq, replace(CASE WHEN surt LIKE '%://()%' THEN 'default...' ELSE split_part(split_part(surt, '://(', 2), ')', 1) END, ':', '#') AS core FROM su"))
def surt_core_key(s, d):
    return v.pages(s, d).select("seq", urls.core_key(F.col("u")).alias("core"))


@query(q("wd", TB, worksets("wd"), body="SELECT seq, u, h AS prefix, ws FROM ws"))
def workset_assign(s, d):
    return assignment.with_workset(v.wide(s, d)).select("seq", "u", "prefix", "ws")


@query(q("bare AS (SELECT c_custkey AS seq, 'http://c' || c_custkey || '.org' AS u FROM customer)", TB, worksets("bare"), body=f"SELECT seq, u, ws, ws % {v.CLIENTS} AS client FROM ws"))
def which(s, d):
    from spindrift.api import Frontier

    bare = v.wide(s, d).select("seq", F.concat(F.lit("c"), F.col("seq").cast("string"), F.lit(".org")).alias("u"))
    return Frontier.create(s, v.CLIENTS).which(bare).select("seq", "u", "ws", "client")


@query(q("pg", body="SELECT seq, CASE WHEN p = '' THEN 0 WHEN right(p, 1) = 'R' THEN 1 WHEN right(p, 1) IN ('E', 'I') THEN 2 ELSE 3 END AS prio FROM pg"))
def priority_assign(s, d):
    return v.pages(s, d).select("seq", urls.priority(F.col("p")).alias("prio"))


@query(q("pg", body=r"SELECT seq, regexp_extract(u, '^([^:/?#]+)://', 1) AS scheme, regexp_extract(u, '^[^:/?#]+://([^/?#]*)', 1) AS host, regexp_extract(u, '^[^:/?#]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(u, '^[^?#]+\?([^#]*)', 1) AS query FROM pg"))
def url_key_parts(s, d):
    k = v.pages(s, d).select("seq", urls.key_parts(F.col("u")).alias("k"))
    return k.select("seq", "k.scheme", "k.host", "k.path", "k.query")


# assignment

@query(q("jb", body="SELECT name, ws, client FROM jb"))
def wscl_default(s, d):
    return assignment.explode_wscl(assignment.valid_wscl(v.jobs(s, d))).select("name", "ws", "client")


@query(q("jb", body="SELECT client, string_agg(ws::VARCHAR, ',' ORDER BY ws) AS worksets FROM jb WHERE name = 'europe' GROUP BY 1"))
def client_worksets(s, d):
    out = assignment.client_worksets(jobs.get_job(v.jobs(s, d), "europe"))
    return out.select("client", F.array_join(F.col("worksets").cast("array<string>"), ",").alias("worksets"))


@query("SELECT (n_nationkey // (SELECT ceil(count(*) / 3.0)::INT FROM nation))::INT AS server, n_nationkey::INT AS client FROM nation")
def server_clients(s, d):
    return assignment.server_clients(v.table(s, d, "nation").select(F.col("n_nationkey").cast("int").alias("client")), 3)


@query(q("wd", TB, worksets("wd"), body=f"SELECT ((ws % 25) // {v.SERVERS})::INT AS server, count(*) AS n FROM ws GROUP BY 1"))
def distribute_counts(s, d):
    return assignment.distribute(v.wide(s, d), assignment.default_wscl(s, v.CLIENTS), v.SERVERS).groupBy("server").agg(F.count("*").alias("n"))


@query(q("wd", TB, worksets("wd"), body=f"SELECT seq, ((ws % 25) // {v.SERVERS})::INT AS server FROM ws WHERE ((ws % 25) // {v.SERVERS}) IN (0, 2, 3)"))
def shuffle_targets(s, d):
    alive = s.createDataFrame([(0,), (1,), (2,), (3,)], "server int")
    return assignment.shuffle_targets(assignment.with_workset(v.wide(s, d)), 1, alive, v.SERVERS).select("seq", "server")


# domains and dispatch

LOOKUP = r"""lh AS (SELECT *, regexp_replace(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1), ':\d*$', '') AS host FROM pg),
lu AS (SELECT lh.*, i.domain, i.exclude FROM lh LEFT JOIN (SELECT host, max_by(domain, length(domain)) AS domain, max_by(exclude, length(domain)) AS exclude
  FROM (SELECT DISTINCT host FROM lh) JOIN dm ON host = domain OR ends_with(host, '.' || domain) GROUP BY host) i USING (host))"""


@query(q("pg", "dm", LOOKUP, body="SELECT seq, domain, exclude FROM lu"))
def domain_lookup(s, d):
    return with_domain_info(v.pages(s, d), v.domains(s)).select("seq", "domain", "exclude")


@query(q("pg", "dm", LOOKUP, body="SELECT seq, u FROM lu WHERE exclude <> 0"))
def excluded_urls(s, d):
    return with_domain_info(v.pages(s, d), v.domains(s)).where("coalesce(exclude, 0) <> 0").select("seq", "u")


ROUTED = ",\n".join([SQL["pg"], SQL["dm"], SQL["ac"], TB, LOOKUP, worksets("lu"), ided("ws", "wi"), f"""
rt AS (SELECT wi.*, CASE WHEN ws % {v.CLIENTS} NOT IN (SELECT client FROM ac WHERE last_feed > (SELECT max(last_feed) FROM ac) - INTERVAL 10 HOURS) THEN 'saved'
  WHEN coalesce(exclude, 0) <> 0 THEN 'excluded' ELSE 'candidate' END AS route FROM wi)"""])
SEEN3 = "sn AS (SELECT DISTINCT id AS key FROM rt WHERE seq % 3 = 0)"


def _routed(s, d):
    now = v.table(s, d, "events").agg(F.max("ts")).first()[0]
    active = dispatch.active_clients(v.activity(s, d), now)
    return dispatch.route(v.pages(s, d), assignment.default_wscl(s, v.CLIENTS), active, v.domains(s))


@query("WITH " + ROUTED + " SELECT seq, id, ws, route FROM rt")
def route_rows(s, d):
    return _routed(s, d).select("seq", "id", "ws", "route")


@query("WITH " + ROUTED + ", " + SEEN3 + """, sc AS (SELECT DISTINCT id FROM rt WHERE route = 'candidate' AND f = 0 AND id NOT IN (SELECT key FROM sn)),
fc AS (SELECT count(*) AS n FROM rt WHERE route = 'candidate' AND f = 1)
SELECT count(*) AS processed, count(*) FILTER (route = 'excluded') AS excluded, count(*) FILTER (route = 'saved') AS saved, (SELECT count(*) FROM sc) + (SELECT n FROM fc) AS scheduled,
  count(*) - count(*) FILTER (route = 'excluded') - count(*) FILTER (route = 'saved') - (SELECT count(*) FROM sc) - (SELECT n FROM fc) AS seen FROM rt""")
def route_counters(s, d):
    old = v.pages(s, d).where("seq % 3 = 0").select(fp.frontier_id("u").alias("key")).distinct()
    return dispatch.counters(_routed(s, d), old)


LINKED = ",\n".join([SQL["lk"], TB, ided("lk")])


def _linked(s, d):
    return v.links(s, d).withColumn("id", fp.frontier_id("u"))


@query("WITH " + LINKED + " SELECT min(seq) AS seq, arg_min(u, seq) AS u, id FROM ix WHERE id NOT IN (SELECT id FROM ix WHERE seq % 3 = 0) GROUP BY id")
def seen_check_merge(s, d):
    x = _linked(s, d)
    old = x.where("seq % 3 = 0").select(F.col("id").alias("key")).distinct()
    return dispatch.unseen(x, old, strict=True).select("seq", "u", "id")


@query("WITH " + LINKED + " SELECT id AS key, CASE WHEN bool_or(seq % 3 = 0) THEN 5 ELSE 0 END::BIGINT AS ts FROM ix GROUP BY id")
def seen_merge_union(s, d):
    x = _linked(s, d)
    old = x.where("seq % 3 = 0").select(F.col("id").alias("key"), F.lit(5).alias("ts")).distinct()
    return dispatch.merge_union(x, old)


LOOKED = ",\n".join([SQL["pg"], TB, ided("pg")])


@query("WITH " + LOOKED + f""" SELECT seq, u, CASE WHEN f = 1 THEN NULL ELSE id END AS id, CASE WHEN seq % 2 = 0 THEN 'wp' ELSE p END AS p, CASE WHEN seq % 2 = 0 THEN NULL ELSE 'via' END AS v, NULL::VARCHAR AS x
FROM ix WHERE f = 1 OR seq % 3 <> 0 OR (seq % 6 = 0)""")
def seen_check_lookup(s, d):
    w = F.when(F.col("seq") % 2 == 0, F.struct(F.lit("wp").alias("p"), F.lit(None).cast("string").alias("v"), F.lit(None).cast("string").alias("x")))
    rows = v.pages(s, d).withColumns({"id": fp.frontier_id("u"), "v": F.lit("via"), "x": F.lit(None).cast("string"), "w": w})
    old = rows.where("seq % 3 = 0").select(F.col("id").alias("key"), F.when(F.col("seq") % 6 == 0, 50).otherwise(NEVER).cast("long").alias("e"))
    return dispatch.hops(dispatch.lookup_check(rows, old, 100)).select("seq", "u", "id", "p", "v", "x")


# sorted readers and seen sets

@query("WITH " + LINKED + " SELECT seq // 1000000 AS file, id, max(seq) AS pos, arg_max(u, seq) AS u FROM ix GROUP BY 1, 2")
def sorted_reader_dedup(s, d):
    x = _linked(s, d).select(F.floor(F.col("seq") / 1_000_000).alias("file"), "id", F.col("seq").alias("pos"), "u")
    return seen.sorted_segment(x).select("file", "id", "pos", "u")


@query("WITH " + LINKED + " SELECT seq // 1000000 AS file, count(*) AS items, count(*) - count(DISTINCT id) AS dups FROM ix GROUP BY 1")
def reader_dup_counts(s, d):
    return seen.dup_counts(_linked(s, d).withColumn("file", F.floor(F.col("seq") / 1_000_000)))


@query("WITH " + LINKED + " SELECT id, max(seq) AS seq FROM ix GROUP BY id")
def merge_sorted_readers(s, d):
    return dispatch.last_per_key(_linked(s, d).select("id", "seq")).orderBy("id")


KEYS = "ky AS (SELECT row_number() OVER (ORDER BY seq) AS pos, id AS key FROM ix)"


@query("WITH " + LOOKED + """, nb AS (SELECT seq AS pos, id AS key, lag(id) OVER (ORDER BY seq) AS prev FROM ix)
SELECT count(*) AS records, count(*) FILTER (key < prev) AS out_of_order, count(*) FILTER (key = prev) AS duplicates, arg_min(key, pos) AS first, arg_max(key, pos) AS last,
  count(*) FILTER (key <= prev) = 0 AS ok FROM nb""")
def seen_integrity(s, d):
    return seen.integrity(v.pages(s, d).select(F.col("seq").alias("pos"), fp.frontier_id("u").alias("key")))


@query("WITH " + LINKED + " SELECT id AS key, max(seq % 97)::BIGINT AS ts FROM ix GROUP BY id")
def seen_repair(s, d):
    x = _linked(s, d).select(F.col("id").alias("key"), (F.col("seq") % 97).alias("ts"), "seq")
    return seen.repair(*(x.where(F.col("seq") % 3 == k).select("key", "ts") for k in range(3)))


@query("WITH " + LOOKED + " SELECT id AS key, 0::BIGINT AS ts FROM ix")
def seen_convert(s, d):
    return seen.convert_v1(v.pages(s, d).select(fp.frontier_id("u").alias("key")))


@query("WITH " + LINKED + " SELECT count(DISTINCT id) AS n FROM ix")
def seen_count(s, d):
    return _linked(s, d).select("id").distinct().agg(F.count("*").alias("n"))


@query("WITH " + LOOKED + " SELECT seq, ((id >> 54) & 1023)::INT AS win FROM ix")
def id_window_split(s, d):
    return seen.id_window(v.pages(s, d).withColumn("id", fp.frontier_id("u"))).select("seq", "win")


@query("WITH " + LINKED + " SELECT count(DISTINCT id) AS distinct_ids, count(*) AS all_ids, count(DISTINCT id) / count(*) AS novelty FROM ix")
def novelty_ratio(s, d):
    return seen.novelty(_linked(s, d))


@query("WITH " + LINKED + ", fpx AS (SELECT *, seq % 8192 AS fp FROM ix) SELECT u AS url, min(seq) AS seq FROM fpx WHERE fp BETWEEN 0 AND 4095 GROUP BY 1")
def legacy_dump_dedup(s, d):
    x = v.links(s, d).select(F.col("u").alias("url"), (F.col("seq") % 8192).alias("fp"), "seq")
    return seen.url_range_dedup(x, 0, 4095).select("url", "seq")


@query(q("lk", body="SELECT count(*) FILTER (ok AND NOT bad) AS count, count(*) FILTER (NOT ok) AS dropped, count(*) FILTER (ok AND bad) AS failed, (count(*) FILTER (ok AND NOT bad)) / 8.0::DOUBLE AS rate, coalesce(string_agg(DISTINCT s, ',' ORDER BY s) FILTER (NOT ok), '') AS ignored FROM (SELECT seq % 13 = 0 AS bad, string_split(u, ':')[1] AS s, strpos(u, ':') > 1 AND string_split(u, ':')[1] IN ('http', 'https', 'ftp') AS ok FROM lk)"))
def scheme_filter_report(s, d):
    return status.submission_report(v.links(s, d), urls.scheme_ok(F.col("u")), failed=F.col("seq") % 13 == 0, seconds=8.0)


# feed and results

@query("""WITH RECURSIVE r AS (SELECT (c_custkey % 7)::INT AS ws_index, c_custkey AS seq, row_number() OVER (PARTITION BY c_custkey % 7 ORDER BY c_custkey) AS rn FROM customer),
t AS (SELECT *, (rn - 1) // 11 AS round, (ws_index - 3 + 7) % 7 AS turn FROM r),
o AS (SELECT *, row_number() OVER (ORDER BY round, turn, rn) AS pos FROM t),
b AS (SELECT *, min(pos) OVER (PARTITION BY round, turn) - 1 AS before FROM o)
SELECT ws_index, seq, pos::INT AS pos FROM b WHERE before < 40""")
def feed_round_robin(s, d):
    rows = v.wide(s, d).select((F.col("seq") % 7).cast("int").alias("ws_index"), "seq")
    return feed.feed(rows, 40, 3, 7).select("ws_index", "seq", "pos")


@query(q("pg", body="SELECT seq, prio FROM (SELECT *, row_number() OVER (PARTITION BY prio ORDER BY seq) AS rn FROM (SELECT seq, CASE WHEN p = '' THEN 0 WHEN right(p, 1) = 'R' THEN 1 WHEN right(p, 1) IN ('E', 'I') THEN 2 ELSE 3 END AS prio FROM pg)) WHERE rn <= 10"))
def feed_priority_burst(s, d):
    return feed.priority_burst(v.pages(s, d).withColumn("prio", urls.priority(F.col("p"))), 10).select("seq", "prio")


@query(q("pg", body="SELECT seq, CASE WHEN seq % 2 = 0 THEN 'ap' ELSE p END AS p, 'v0' AS v, CASE WHEN seq % 6 = 0 THEN 200 END::INT AS s, seq % 6 = 0 AS has_a FROM pg"))
def makecuri(s, d):
    none = F.lit(None).cast("string")
    a = F.when(F.col("seq") % 2 == 0, F.struct(F.when(F.col("seq") % 6 == 0, 200).alias("s"), F.lit("ap").alias("p"), none.alias("v"), none.alias("x")))
    rows = v.pages(s, d).withColumns({"v": F.lit("v0"), "x": none, "a": a})
    return feed.makecuri(rows).select("seq", "p", "v", "a.s", F.col("a").isNotNull().alias("has_a"))


FINISHED = ",\n".join([SQL["wd"], TB, worksets("wd"), ided("ws", "wi"), "fn AS (SELECT e.event_id AS seq, w.id, w.ws, (CASE WHEN event_type = 'error' THEN 500 ELSE 200 END)::INT AS s, e.event_type AS d FROM events e JOIN wi w ON w.seq = e.user_id)"])


def _finished(s, d):
    w = assignment.with_workset(v.wide(s, d)).withColumn("id", fp.frontier_id("u")).withColumnRenamed("seq", "user_id")
    e = v.table(s, d, "events").select(F.col("event_id").alias("seq"), "user_id", F.when(F.col("event_type") == "error", 500).otherwise(200).alias("s"), F.col("event_type").alias("d"))
    return e.join(w, "user_id")


@query("WITH " + FINISHED + " SELECT ws, count(*) AS finished FROM fn GROUP BY ws")
def finished_by_workset(s, d):
    return feed.finished_by_workset(_finished(s, d))


@query("WITH " + FINISHED + " SELECT id, max(seq) AS seq, arg_max(s, seq) AS s, arg_max(d, seq) AS d FROM fn GROUP BY id")
def crawlinfo_upsert(s, d):
    x = _finished(s, d).select("id", "seq", "s", "d")
    return feed.upsert(x.where("seq % 2 = 0"), x.where("seq % 2 = 1"))


@query("WITH " + FINISHED + ", inf AS (SELECT id, arg_max(s, seq) AS s FROM fn GROUP BY id) SELECT wi.seq, CASE WHEN wi.seq % 5 = 0 THEN 304 ELSE inf.s END::INT AS s FROM wi LEFT JOIN inf USING (id)")
def crawlinfo_enrich(s, d):
    x = _finished(s, d).select("id", "seq", "s", "d")
    rows = v.wide(s, d).select("seq", fp.frontier_id("u").alias("id"), F.when(F.col("seq") % 5 == 0, 304).alias("s"))
    return feed.enrich(rows, feed.upsert(x.limit(0), x)).select("seq", "s")


# status

@query("WITH " + FINISHED + f", g AS (SELECT ws, count(*) AS n FROM wi GROUP BY ws), h AS (SELECT ws, count(*) AS n FROM fn GROUP BY ws) SELECT g.ws % {v.CLIENTS} AS client, sum(g.n)::BIGINT AS scheduled, sum(coalesce(h.n, 0))::BIGINT AS finished, sum(greatest(g.n - coalesce(h.n, 0), 0))::BIGINT AS active, count(*) AS n_worksets, string_agg(g.ws::VARCHAR, ',' ORDER BY g.ws) AS worksets FROM g LEFT JOIN h USING (ws) GROUP BY 1")
def client_status(s, d):
    g = assignment.with_workset(v.wide(s, d)).groupBy("ws").agg(F.count("*").alias("scheduled"))
    x = g.join(feed.finished_by_workset(_finished(s, d)), "ws", "left").withColumn("finished", F.coalesce("finished", F.lit(0)))
    return status.client_status(x.join(assignment.default_wscl(s, v.CLIENTS), "ws"))


@query(q("pg", body="SELECT prio, count(*) AS n FROM (SELECT CASE WHEN p = '' THEN 0 WHEN right(p, 1) = 'R' THEN 1 WHEN right(p, 1) IN ('E', 'I') THEN 2 ELSE 3 END AS prio FROM pg) GROUP BY ROLLUP (prio)"))
def priority_status(s, d):
    return v.pages(s, d).withColumn("prio", urls.priority(F.col("p"))).rollup("prio").agg(F.count("*").alias("n"))


@query(q("ac", body="SELECT client FROM ac WHERE last_feed > (SELECT max(ts) FROM events) - INTERVAL 10 HOURS"))
def client_activity(s, d):
    return dispatch.active_clients(v.activity(s, d), v.table(s, d, "events").agg(F.max("ts")).first()[0])


@query("SELECT event_id, client, coalesce(t - lag(t) OVER w > 36000, true) AS activates FROM (SELECT event_id, (user_id % 150)::INT AS client, epoch(date_trunc('second', ts))::BIGINT * 100000 + event_id AS o, epoch(date_trunc('second', ts))::BIGINT AS t FROM events) WINDOW w AS (PARTITION BY client ORDER BY o)")
def client_transitions(s, d):
    e = v.table(s, d, "events").select("event_id", (F.col("user_id") % 150).cast("int").alias("client"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("ts"))
    return status.transitions(e).select("event_id", "client", "activates")


@query(q("rg", "lv AS (SELECT 'job' || n_regionkey AS job, lower(n_name) AS name FROM nation WHERE n_nationkey % 3 = 0)",
         body="SELECT job, name, svid::INT AS svid FROM rg UNION ALL SELECT job, name, NULL FROM lv WHERE (job, name) NOT IN (SELECT job, name FROM rg)"))
def job_servers(s, d):
    live = v.table(s, d, "nation").where("n_nationkey % 3 = 0").select(F.concat(F.lit("job"), F.col("n_regionkey").cast("string")).alias("job"), F.lower("n_name").alias("name"))
    return status.job_servers(v.registered(s, d), live)


@query(q("rg", body="SELECT job, string_agg(name, ',' ORDER BY name) AS servers, count(*) AS n FROM rg GROUP BY job"))
def job_status_pivot(s, d):
    return status.job_status_pivot(v.registered(s, d).withColumnRenamed("name", "server"))


@query("SELECT key, ts, CASE WHEN dt > 0 AND dt < 3600 AND dn BETWEEN 0 AND 1000000 THEN dn / dt END AS rate, CASE WHEN dt > 0 AND dt < 3600 AND dn BETWEEN 0 AND 100000 THEN dn / dt END AS out_rate FROM (SELECT key, ts, ts - lag(ts) OVER w AS dt, n - lag(n) OVER w AS dn FROM (SELECT user_id % 3 AS key, event_id * 700 % 5000 + event_id * 900 AS ts, event_id * event_id AS n FROM events) WINDOW w AS (PARTITION BY key ORDER BY ts, n))")
def throughput_deltas(s, d):
    e = v.table(s, d, "events").select((F.col("user_id") % 3).alias("key"), (F.col("event_id") * 700 % 5000 + F.col("event_id") * 900).alias("ts"), (F.col("event_id") * F.col("event_id")).alias("n"))
    return status.rates(e.withColumn("out", F.col("n"))).select("key", "ts", "rate", "out_rate")


# formats

@query(q("pg", body="SELECT CASE WHEN seq % 4 = 0 THEN 'http://h' || seq || '.com/' ELSE u END AS u, '' AS p FROM pg WHERE seq % 5 <> 0"))
def seed_parse(s, d):
    line = F.when(F.col("seq") % 5 == 0, F.concat(F.lit("# "), "u")).when(F.col("seq") % 4 == 0, F.concat(F.lit(" h"), F.col("seq").cast("string"), F.lit(".com"))).otherwise(F.col("u"))
    return formats.parse_seeds(v.pages(s, d).select(line.alias("value")))


@query(q("pg", body="SELECT u, 'via' AS v, CASE WHEN p = '' THEN NULL ELSE p END AS p, NULL::VARCHAR AS x FROM pg WHERE seq % 3 <> 0"))
def uvpx_parse(s, d):
    p = F.when(F.col("p") == "", "null").otherwise(F.col("p"))
    line = F.when(F.col("seq") % 3 == 0, F.concat_ws(" ", "u", p)).otherwise(F.concat_ws(" ", "u", F.lit("via"), p, F.lit("null")))
    return formats.parse_uvpx(v.pages(s, d).select(line.alias("value"))).select("u", "v", "p", "x")


@query(q("pg", body="SELECT u, 'LL' AS p, 'via' AS v FROM pg WHERE seq % 3 <> 0"))
def divert_parse(s, d):
    line = F.concat_ws(" ", F.lit("1"), F.when(F.col("seq") % 3 == 0, "Other").otherwise("CrawlURI"), "u", F.lit("LL"), F.lit("via"))
    return formats.parse_divert(v.pages(s, d).select(line.alias("value")))


@query(q("pg", body="SELECT u, 200 AS s, 'sha1:x' AS d, epoch(TIMESTAMP '2012-01-02 03:04:05')::BIGINT AS m FROM pg WHERE seq % 4 NOT IN (0, 1)"))
def crawllog_parse(s, d):
    code = F.when(F.col("seq") % 4 == 0, "-5").otherwise("200")
    size = F.when(F.col("seq") % 4 == 1, "-").otherwise("17")
    line = F.concat_ws("  ", F.lit("2012-01-02T03:04:06.000Z"), code, size, "u", F.lit("L v text/html #1"), F.lit("20120102030405123+9 sha1:x - -"))
    return formats.parse_crawl_log(v.pages(s, d).select(line.alias("value")))


@query(q("pg", body="SELECT u, 'wp' AS p, 'av' AS v FROM pg WHERE seq % 2 = 0"))
def queue_parse(s, d):
    r = F.to_json(F.struct("u", F.struct(F.lit("ap").alias("p"), F.lit("av").alias("v")).alias("a"), F.struct(F.lit("wp").alias("p")).alias("w")))
    line = F.when(F.col("seq") % 2 == 0, F.concat(F.lit(" "), r)).otherwise(F.concat(F.lit("#"), r))
    return formats.parse_requeue(v.pages(s, d).select(line.alias("value"))).select("u", "p", "v")


@query(q("pg", body="SELECT seq, u, p, f FROM pg"))
def queue_roundtrip(s, d):
    path = scratch(s, "queue")
    formats.write_queue(v.pages(s, d), path)
    return formats.read_queue(s, path, schema="seq BIGINT, u STRING, p STRING, f INT")


@query("WITH " + LOOKED + " SELECT seq, upper(string_agg(substr(lpad(printf('%X', CASE WHEN k = 0 THEN id::HUGEINT + CASE WHEN id < 0 THEN 18446744073709551616::HUGEINT ELSE 0 END ELSE seq::HUGEINT END), 16, '0'), (15 - 2 * b)::INT, 2), '' ORDER BY k, b)) AS record FROM ix, range(2) t(k), range(8) u(b) WHERE k = 0 OR b < 4 GROUP BY seq".replace("printf('%X', ", "to_hex("))
def seen_binary_record(s, d):
    rows = v.pages(s, d).select(fp.frontier_id("u").alias("key"), F.col("seq").alias("ts"))
    return rows.select(F.col("ts").alias("seq"), F.hex(formats.pack_seen(rows)).alias("record"))


@query(q("pg", body="SELECT 'http://' || split_part(u, '://', 2) AS u FROM pg WHERE seq % 3 = 1"))
def nocrawl_seeds(s, d):
    seeds = v.pages(s, d).select(F.substring_index("u", "://", -1).alias("url"), F.struct((F.col("seq") % 3).alias("active")).alias("nocrawl"))
    return jobs.nocrawl_seeds(seeds)


@query("WITH " + LOOKED + " SELECT seq, u, id FROM ix")
def stream_dispatch(s, d):
    from spindrift.streaming import dispatcher

    root = scratch(s, "stream")
    x = v.pages(s, d).select("seq", "u")
    x.unionByName(x.where("seq % 2 = 0")).repartition(3, "u").write.parquet(f"{root}/in")
    return dispatcher.run(s, f"{root}/in", root, "seq long, u string", compact_every=2).select("seq", "u", "id")


def scratch(spark: SparkSession, tag: str) -> str:
    """A new folder that all executors share, which goes when the driver ends."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return f"{path}/data"


from spindrift.plans import tools  # noqa: E402, F401  (its queries register here)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_oracles)
