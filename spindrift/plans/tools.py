"""Queries of the catalogue over sinks, stores, jobs, legacy keys and keyed streams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from spindrift.functions import fingerprint as fp
from spindrift.functions import urls
from spindrift.operators import activation, assignment, dispatch, feed, jobs, seen, status
from spindrift.plans import views as v
from spindrift.plans.catalog import FINISHED, LINKED, LOOKED, TB, _finished, ided, q, query, scratch, worksets
from spindrift.plans.views import SQL
from spindrift.schemas import NEVER
from spindrift.sources import formats, queues

ROWS = "seq BIGINT, u STRING, p STRING, f INT"
PRIO = "CASE WHEN p = '' THEN 0 WHEN right(p, 1) = 'R' THEN 1 WHEN right(p, 1) IN ('E', 'I') THEN 2 ELSE 3 END"

# prefixes of many kinds of hosts; the expected form is written out by hand for each

FAMILIES = [
    ("www.n{k}.com", "com,n{k},"), ("a.b.n{k}.co.jp", "jp,co,n{k},"), ("n{k}.com.sg", "sg,com,n{k},"), ("www.n{k}.co.il", "il,co,n{k},"),
    ("x.n{k}.com.pl", "pl,com,n{k},"), ("n{k}.co.id", "id,co,n{k},"), ("www.n{k}.gouv.fr", "fr,gouv,n{k},"), ("www.n{k}.zzz", "zzz,n{k},"),
    ("www.n{k}.co.uk", "uk,co,n{k},"), ("www.bl.uk", "uk,bl,"), ("w.n{k}.public.tokyo.jp", "jp,tokyo,public,n{k},"), ("s{k}.metro.tokyo.jp", "jp,tokyo,metro,"),
    ("n{k}", "n{k}"), ("10.0.{k}.1:80", "10.0.{k}.1"), ("[2001:db8::{k}]:8080", "[2001:db8::{k}]"), ("user:pw@www.Bad-n{k}.de:81", "de,Bad-n{k},"),
]


def _family(rows, i, lit, join, key):
    parts = rows[i].split("{k}")
    return lit(parts[0]) if len(parts) == 1 else join(lit(parts[0]), key, lit(parts[1]))


def _family_sql(column):
    whens = " ".join(f"WHEN {i} THEN " + _family([f[column] for f in FAMILIES], i, lambda t: f"'{t}'", lambda *p: " || ".join(p), "k") for i in range(len(FAMILIES)))
    return f"CASE c_custkey % {len(FAMILIES)} {whens} END"


@query(f"SELECT c_custkey AS seq, 'http://' || {_family_sql(0)} || '/x?y' AS u, {_family_sql(1)} AS prefix FROM (SELECT c_custkey, (c_custkey % 200)::VARCHAR AS k FROM customer)")
def prefix_families(s, d):
    k = (F.col("c_custkey") % 200).cast("string")
    which = F.col("c_custkey") % len(FAMILIES)
    hosts = [_family([f[0] for f in FAMILIES], i, F.lit, F.concat, k) for i in range(len(FAMILIES))]
    host = F.coalesce(*(F.when(which == i, h) for i, h in enumerate(hosts)))
    rows = v.table(s, d, "customer").select(F.col("c_custkey").alias("seq"), F.concat(F.lit("http://"), host, F.lit("/x?y")).alias("u"))
    return rows.select("seq", "u", urls.domain_prefix(F.col("u")).alias("prefix"))


# large batches

@query(q("bk", body="SELECT min(seq) AS seq, u FROM bk WHERE f = 0 AND u NOT IN (SELECT u FROM bk WHERE seq % 3 = 0) GROUP BY u UNION ALL SELECT seq, u FROM bk WHERE f = 1"))
def seen_check_bulk(s, d):
    x = v.bulk(s, d)
    old = x.where("seq % 3 = 0").select(fp.frontier_id("u").alias("key")).distinct()
    return dispatch.unseen(x.withColumn("id", fp.frontier_id("u")), old).select("seq", "u")


@query(q("bk", body="SELECT count(*) AS n, count(DISTINCT u) AS ids FROM bk"))
def fingerprint_bulk(s, d):
    return v.bulk(s, d).select(fp.frontier_id("u").alias("id")).agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"))


# legacy keys and values

@query(q("pg", TB, "lg AS (SELECT seq, CASE WHEN seq % 2 = 0 THEN u || repeat('/abcdefghi', 80) ELSE u END AS u FROM pg)",
         body="SELECT seq, substr(u, 1, 790) AS u1, CASE WHEN length(u) > 790 THEN substr(u, 791) END AS u2, length(u) > 790 AS hashed, u AS joined FROM lg"))
def url_key_split(s, d):
    u = F.when(F.col("seq") % 2 == 0, F.concat("u", F.repeat(F.lit("/abcdefghi"), F.lit(80)))).otherwise(F.col("u"))
    k = v.pages(s, d).select("seq", urls.split_key(u).alias("k"))
    return k.select("seq", "k.u1", "k.u2", F.col("k.h").rlike("^#[0-9a-f]{1,8}$").alias("hashed"), urls.joined_url(F.col("k")).alias("joined"))


@query(q("pg", TB, body=f"SELECT seq, '#' || lower(to_hex({fp.duck_unsigned('u')})) AS h, u FROM pg, tb"))
def hashed_key(s, d):
    return v.pages(s, d).select("seq", urls.hashed_key(F.col("u")).alias("k")).select("seq", "k.h", "k.u")


@query(q("pg", TB, "lq AS (SELECT seq, u || '?' || repeat('q', 801) AS u, repeat('q', 801) AS query FROM pg)",
         body=f"SELECT seq, '#' || lower(to_hex({fp.duck_unsigned('query')})) AS query, u AS url FROM lq, tb WHERE u NOT LIKE '%?%?%' AND u NOT LIKE '%#%'"))
def long_part_key(s, d):
    rows = v.pages(s, d).select("seq", F.concat("u", F.lit("?"), F.repeat(F.lit("q"), F.lit(801))).alias("u")).where("u not like '%?%?%' and u not like '%#%'")
    k = rows.select("seq", urls.key_parts(F.col("u")).alias("k"))
    return k.select("seq", "k.query", urls.url_of_parts(F.col("k")).alias("url"))


@query(q("pg", TB, "ex AS (SELECT seq, u || '/more' AS u FROM pg)", body=f"SELECT seq, {fp.duck_id('u')} AS id FROM ex, tb"))
def fingerprint_extend(s, d):
    return v.pages(s, d).select("seq", fp.extend(fp.frontier_id("u"), F.lit("/more")).alias("id"))


@query(f"SELECT event_id, (event_id * 1000003 - 5000)::BIGINT AS m, CASE WHEN ms < 0 THEN '-' ELSE '' END || CASE WHEN abs(ms) >= 3600000 THEN abs(ms) // 3600000 || 'h' ELSE '' END || CASE WHEN abs(ms) >= 60000 THEN abs(ms) // 60000 % 60 || 'm' ELSE '' END || abs(ms) // 1000 % 60 || 's' || abs(ms) % 1000 || 'ms' AS delta, format('{{:,}}', event_id * 977) AS n FROM (SELECT event_id, (event_id - 500) * 7919 AS ms FROM events)")
def format_values(s, d):
    e = v.table(s, d, "events").select("event_id", (F.col("event_id") * 1000003 - 5000).cast("long").alias("m"))
    return e.select("event_id", formats.unpack_modified(formats.pack_modified(F.col("m"))).alias("m"),
                    status.time_delta((F.col("event_id") - 500) * 7919).alias("delta"), status.with_comma(F.col("event_id") * 977).alias("n"))


# submissions

@query(q("pg", body="SELECT u, CASE WHEN seq % 3 = 0 THEN NULL ELSE p END AS p, (seq % 3 = 0 OR f = 1)::INT AS f FROM pg WHERE seq % 3 < 2"))
def discovered_bodies(s, d):
    one = F.to_json(F.struct("u", "p", "f"))
    body = F.when(F.col("seq") % 3 == 0, F.concat(F.lit('{"f": 1, "u": ['), F.to_json(F.struct("u")), F.lit("]}")))
    body = body.when(F.col("seq") % 3 == 1, F.concat(F.lit("["), one, F.lit("]"))).otherwise(F.lit('{"x": 1}'))
    return formats.parse_discovered(v.pages(s, d).select(body.alias("value"))).select("u", "p", "f")


@query(q("wd", body="SELECT key, chunk, count(*) AS n FROM (SELECT seq % 3 AS key, (row_number() OVER (PARTITION BY seq % 3 ORDER BY seq) - 1) // 50 AS chunk FROM wd) GROUP BY ALL"))
def submission_chunks(s, d):
    rows = v.wide(s, d).withColumn("key", F.col("seq") % 3)
    return feed.in_chunks(rows, 50, by="key").groupBy("key", "chunk").agg(F.count("*").alias("n"))


@query(q("bk", body="SELECT count(*)::BIGINT AS rows, count(*)::BIGINT AS sent FROM bk"))
def submitted_rows(s, d):
    return status.submit(v.bulk(s, d), lambda chunk: 0 < len(chunk) <= 500).agg(F.sum("rows").alias("rows"), F.sum("sent").alias("sent"))


# queues and sinks

def _priority_folder(s, d):
    path = scratch(s, "prio")
    for part in range(2):
        queues.write_priority(v.pages(s, d).where(F.col("seq") % 2 == part), path)
    return path


def _moved(s, path):
    """The folder with its files under names that a queue's segments have."""
    from spindrift.streaming.dispatcher import files_of

    for i, (folder, name) in enumerate(files_of(s, path)):
        jvm = s.sparkContext._jvm
        old, new = (jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}") for n in (name, f"{100 + i}.gz"))
        old.getFileSystem(s.sparkContext._jsc.hadoopConfiguration()).rename(old, new)
    return path


@query(q("pg", body=f"SELECT {PRIO} AS prio, seq, u FROM pg"))
def priority_sink(s, d):
    return queues.read_directory(s, _moved(s, _priority_folder(s, d)), schema=ROWS).select("prio", "seq", "u")


@query(q("pg", body=f"SELECT {PRIO} AS prio, count(*) AS n FROM pg GROUP BY 1 ORDER BY 1"))
def priority_scan(s, d):
    path = _moved(s, _priority_folder(s, d))
    rows = queues.read_directory(s, path, schema=ROWS).groupBy("prio").agg(F.count("*").alias("n"))
    return queues.priorities(s, path).select("prio").join(rows, "prio")


@query(q("pg", body=f"SELECT count(*) AS n, max(prio) AS prio FROM (SELECT {PRIO} AS prio, seq % 4 AS file FROM pg) WHERE prio = 0 AND file = (SELECT min(seq % 4) FROM pg WHERE {PRIO} = 0)"))
def priority_bulk(s, d):
    rows = v.pages(s, d).select(urls.priority(F.col("p")).alias("prio"), (F.col("seq") % 4).alias("file"), "seq")
    return feed.next_segment(rows).agg(F.count("*").alias("n"), F.max("prio").alias("prio"))


@query(q("pg", body=f"SELECT row_number() OVER (ORDER BY {PRIO}, seq % 4, seq) AS place, seq FROM pg"))
def priority_order(s, d):
    rows = v.pages(s, d).select(urls.priority(F.col("p")).alias("prio"), (F.col("seq") % 4).alias("file"), F.col("seq").alias("pos"), "seq")
    ordered = feed.priority_order(rows).coalesce(1).select((F.monotonically_increasing_id() + 1).alias("place"), "seq")  # the order is the result
    return ordered


@query(q("wd", TB, worksets("wd"), body="SELECT ws, seq, u FROM ws"))
def workset_sink(s, d):
    path = scratch(s, "ws")
    queues.write_worksets(assignment.with_workset(v.wide(s, d)).drop("prefix"), path)
    lines = s.read.text(path)  # the folder's name is the workset
    return lines.select("ws", F.from_json(F.expr("substring(value, 2)"), "seq BIGINT, u STRING").alias("r")).select("ws", "r.*")


@query(q("pg", body="SELECT name, seq FROM pg, (VALUES ('a'), ('b'), ('c')) t(name) WHERE name = 'a' OR (name = 'b' AND seq % 2 = 0) OR (name = 'c' AND seq % 3 = 0)"))
def divert_multicast(s, d):
    path = scratch(s, "divert")
    names = F.filter(F.array(F.lit("a"), F.when(F.col("seq") % 2 == 0, "b"), F.when(F.col("seq") % 3 == 0, "c")), lambda x: x.isNotNull())
    queues.write_diverted(v.pages(s, d), path, names)
    return s.read.text(path).select("name", F.from_json(F.expr("substring(value, 2)"), ROWS).alias("r")).select("name", "r.seq")


@query("WITH " + LOOKED + " SELECT ((id >> 54) & 1023)::INT AS win, count(*) AS n FROM ix GROUP BY 1")
def id_window_sink(s, d):
    path = scratch(s, "win")
    queues.write_windows(v.pages(s, d).withColumn("id", fp.frontier_id("u")), path)
    return s.read.text(path).groupBy("win").agg(F.count("*").alias("n"))


@query(q("pg", body="SELECT 5::BIGINT AS segments, count(*) AS n FROM pg"))
def pooled_sink(s, d):
    path = scratch(s, "pool")
    queues.write_pooled(v.pages(s, d), path, 5)
    files = queues.queue_stats(s, _moved(s, path)).select("segments")
    return files.join(queues.read_directory(s, path, schema=ROWS).agg(F.count("*").alias("n")))


@query("WITH " + LOOKED + " SELECT id, max(seq) AS seq FROM ix GROUP BY id")
def sorted_rewrite(s, d):
    source, target = scratch(s, "unsorted"), scratch(s, "sorted")
    rows = v.pages(s, d).withColumn("id", fp.frontier_id("u"))
    formats.write_queue(rows.unionByName(rows).coalesce(2), source)
    queues.rewrite_sorted(s, _moved(s, source), target, "id BIGINT, " + ROWS)
    return queues.read_directory(s, _moved(s, target), schema="id BIGINT, " + ROWS).select("id", "seq")


@query(q("pg", body="SELECT seq, u FROM pg"))
def queue_stream(s, d):
    path, out = scratch(s, "segments"), scratch(s, "streamed")
    formats.write_queue(v.pages(s, d).repartition(3), path)
    stream = queues.stream_queue(s, _moved(s, path), ROWS)
    stream.writeStream.option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start(path=f"{out}/rows", format="parquet").awaitTermination()
    return s.read.schema(ROWS).parquet(f"{out}/rows").select("seq", "u")


# seen sets

@query("WITH " + LOOKED + " SELECT id AS key, seq AS ts FROM ix")
def seen_binary_roundtrip(s, d):
    x = v.pages(s, d).select(fp.frontier_id("u").alias("key"), F.col("seq").alias("ts"))
    out = formats.dump_seen(x, 40).select("content")
    return out.mapInArrow(formats.records_of, "key long, ts long")


@query("WITH " + LOOKED + " SELECT DISTINCT id::VARCHAR AS value FROM ix")
def seen_dump(s, d):
    path = scratch(s, "dump")
    formats.write_seen_text(v.pages(s, d).select(fp.frontier_id("u").alias("key")).distinct(), path)
    return s.read.text(path)


@query("WITH " + LOOKED + " SELECT count(*) AS rows, count(*) FILTER (seq % 3 = 0) AS hits FROM ix")
def seen_probe(s, d):
    x = v.pages(s, d).withColumn("id", fp.frontier_id("u"))
    return seen.probe(x, v.pages(s, d).where("seq % 3 = 0").select(fp.frontier_id("u").alias("key")))


@query("WITH " + LOOKED + " SELECT id AS key, epoch(TIMESTAMP '2012-01-02 03:04:05')::BIGINT + seq % 7 AS ts FROM ix WHERE seq % 4 <> 0")
def seen_rebuild(s, d):
    code = F.when(F.col("seq") % 4 == 0, "-5").otherwise("200")
    at = F.date_format(F.timestamp_seconds(F.unix_timestamp(F.lit("2012-01-02 03:04:05").cast("timestamp")) + F.col("seq") % 7), "yyyyMMddHHmmss")
    line = F.concat_ws(" ", F.lit("2012-01-02T03:04:06.000Z"), code, F.lit("17"), "u", F.lit("L v text/html #1"), F.concat(at, F.lit("+9")), F.lit("sha1:x - -"))
    lines = v.pages(s, d).select(line.alias("value"))
    return seen.rebuild(formats.parse_crawl_log(lines.unionByName(lines)))


@query(q("pg", body="SELECT seq FROM pg WHERE seq % 5 <> 0"))
def recovery_replay(s, d):
    rows = v.pages(s, d).select(F.col("seq").alias("pos"), "seq")
    named = v.pages(s, d).select(F.when(F.col("seq") % 5 == 0, F.col("seq").cast("string")).when(F.col("seq") % 5 == 1, "bad").otherwise("99999999999").alias("value"))
    return seen.replay(rows, formats.recovered_positions(named, 10_000_000)).select("seq")


@query("WITH " + FINISHED + ", inf AS (SELECT w.u, arg_max(f.s, f.seq) AS s FROM fn f JOIN wi w USING (id) GROUP BY 1) SELECT count(*) AS items, count(*) FILTER (s = 500) AS failed FROM inf")
def crawlinfo_count(s, d):
    info = feed.upsert(_finished(s, d).select("id", "seq", "s", "d").limit(0), _finished(s, d).select("id", "seq", "s", "d"))
    return info.agg(F.count("*").alias("items"), F.count_if(F.col("s") == 500).alias("failed"))


@query("WITH " + FINISHED + ", inf AS (SELECT w.u, arg_max(f.s, f.seq) AS s FROM fn f JOIN wi w USING (id) GROUP BY 1) SELECT wd.seq, inf.s::INT AS s FROM wd LEFT JOIN inf USING (u)")
def enrich_by_url(s, d):
    x = _finished(s, d).select(F.col("u").alias("id"), "seq", "s", "d")
    rows = v.wide(s, d).select("seq", F.col("u").alias("id"), F.lit(None).cast("int").alias("s"))
    return feed.enrich(rows, feed.upsert(x.limit(0), x)).select("seq", "s")


# clients, worksets, jobs

@query(q("wd", TB, worksets("wd"), body=f"SELECT seq, (ws % {v.CLIENTS} < 5) AS back, CASE WHEN ws % {v.CLIENTS} < 5 THEN 0 END::INT AS prio FROM ws"))
def divert_reactivate(s, d):
    saved = assignment.with_workset(v.wide(s, d)).drop("prefix")
    before, now = (s.range(lo, hi).select(F.col("id").cast("int").alias("client")) for lo, hi in ((5, 12), (0, 9)))
    back, rest = activation.reactivate(saved, assignment.default_wscl(s, v.CLIENTS), activation.newly_active(before, now))
    return back.select("seq", F.lit(True).alias("back"), F.col("prio").cast("int")).unionByName(rest.select("seq", F.lit(False).alias("back"), F.lit(None).cast("int").alias("prio")))


SPELLS = """sp AS (SELECT *, sum((t - pt > 36000 OR pt IS NULL)::INT) OVER (PARTITION BY client ORDER BY t) AS spell FROM
  (SELECT (user_id % 150)::INT AS client, epoch(date_trunc('second', ts))::BIGINT AS t, lag(epoch(date_trunc('second', ts))::BIGINT) OVER (PARTITION BY user_id % 150 ORDER BY ts) AS pt FROM events)),
sq AS (SELECT client, spell, min(t) AS since, max(t) AS last FROM sp GROUP BY ALL)"""


@query("WITH " + SPELLS + " SELECT client, since, CASE WHEN lead(since) OVER (PARTITION BY client ORDER BY since) IS NOT NULL OR 1706745600 - last > 36000 THEN last + 36000 END AS until FROM sq")
def client_spells(s, d):
    e = v.table(s, d, "events").select((F.col("user_id") % 150).cast("int").alias("client"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("ts")).distinct()
    return activation.deactivations(e, 1706745600)


@query(q("wd", TB, worksets("wd"), body=f"SELECT DISTINCT ws FROM ws WHERE ws % {v.CLIENTS} IN (9, 10, 11)"))
def flushed_worksets(s, d):
    rows = assignment.with_workset(v.wide(s, d))
    before, now = (s.range(lo, hi).select(F.col("id").cast("int").alias("client")) for lo, hi in ((5, 12), (0, 9)))
    return activation.flushed_worksets(rows, assignment.default_wscl(s, v.CLIENTS), before, now)


@query("WITH " + FINISHED + ", g AS (SELECT ws, count(*) AS n FROM wi GROUP BY ws), h AS (SELECT ws, count(*) AS n FROM fn GROUP BY ws) SELECT g.ws, g.n::BIGINT AS scheduled, coalesce(h.n, 0)::BIGINT AS finished, (g.ws % 3)::BIGINT AS files, greatest(g.n - coalesce(h.n, 0), 0)::BIGINT AS active FROM g LEFT JOIN h USING (ws)")
def workset_status(s, d):
    g = assignment.with_workset(v.wide(s, d)).groupBy("ws").agg(F.count("*").alias("scheduled"))
    x = g.join(feed.finished_by_workset(_finished(s, d)), "ws", "left").withColumns({"finished": F.coalesce("finished", F.lit(0)), "files": F.col("ws") % 3})
    return status.workset_status(x)


@query(q("pg", body=f"SELECT prio, sum(seq % 5)::BIGINT AS buffered, count(*) AS files FROM (SELECT {PRIO} AS prio, seq FROM pg) GROUP BY ROLLUP (prio)"))
def queue_status(s, d):
    return status.priority_status(v.pages(s, d).select(urls.priority(F.col("p")).alias("prio"), (F.col("seq") % 5).alias("buffered"), F.lit(1).alias("files")))


@query(q("bk", body="SELECT avg(octet_length(encode(u))) AS bytes FROM bk"))
def url_compression(s, d):
    return status.compression(v.bulk(s, d)).where("packed > 0").select("bytes")


@query(q("wd", TB, worksets("wd"), body=f"SELECT seq, ws, ws % {v.CLIENTS} AS client, ((ws % 25) // 5)::INT AS server, CASE WHEN (ws % 25) // 5 < 3 THEN 'srv' || (ws % 25) // 5 END AS name FROM ws"))
def locate(s, d):
    servers = s.range(3).select(F.col("id").cast("int").alias("server"), F.concat(F.lit("srv"), F.col("id").cast("string")).alias("name"))
    return assignment.locate(v.wide(s, d), assignment.default_wscl(s, v.CLIENTS), servers, 5).select("seq", "ws", "client", "server", "name")


@query(q("jb", body="SELECT name, count(DISTINCT client) AS clients, max(changed) AS changed FROM jb WHERE name <> 'asia' GROUP BY name UNION ALL SELECT 'fresh', 4, 7 UNION ALL SELECT 'asia', 1, 99"))
def job_admin(s, d):
    """Jobs after one is made, one is changed and one is deleted that was made."""
    table = jobs.create_job(s, v.jobs(s, d), "fresh", clients=4, now=7)
    table = jobs.create_job(s, table, "gone")
    changed = table.where("name = 'asia'").select("name", F.transform("wscl", lambda c: (c * 0).cast("int")).alias("wscl"), F.lit(99).cast("long").alias("changed"))
    table = jobs.delete_jobs(jobs.save_job(table, changed), ["gone"])
    return table.select("name", F.size(F.array_distinct("wscl")).cast("long").alias("clients"), "changed")


@query(q("sj", body="SELECT job, server, max(ts) AS ts FROM sj WHERE ts > 13600 GROUP BY ALL"))
def active_jobs(s, d):
    return jobs.active_jobs(v.server_jobs(s, d), 100_000).groupBy("job", "server").agg(F.max("ts").alias("ts"))


@query(q("sj", body="SELECT server, job, max(ts) <= 13600 AS success FROM sj WHERE server IN ('s1', 's2', 's3') GROUP BY ALL UNION ALL SELECT 's1', 'nojob', false"))
def delete_job_servers(s, d):
    asked = v.server_jobs(s, d).where("server in ('s1', 's2', 's3')").select("server", "job")
    asked = asked.unionByName(s.sql("select 's1' as server, 'nojob' as job"))
    return jobs.delete_job_servers(v.server_jobs(s, d), asked, 100_000)[1]


@query(q("rg", body="SELECT job, svid, name FROM rg UNION ALL SELECT 'job1', (SELECT max(svid) + 1 FROM rg WHERE job = 'job1'), 'extra'"))
def add_job_server(s, d):
    return reduce(lambda t, _: jobs.add_job_server(t, "job1", "extra"), range(2), v.registered(s, d))


@query(q("wd", TB, worksets("wd"), body="SELECT seq, CASE WHEN seq % 10 = 0 THEN -1 WHEN seq % 10 = 1 AND seq % 3 = 0 THEN 900 WHEN row_number() OVER (PARTITION BY ws, NOT (seq % 10 = 0 OR (seq % 10 = 1 AND seq % 3 = 0)) ORDER BY seq) <= 2 THEN 1000 ELSE 0 END::BIGINT AS co FROM ws"))
def checkout_states(s, d):
    """A tenth is done, some were checked out lately and some too long ago; two of each workset go out."""
    rows = assignment.with_workset(v.wide(s, d)).withColumn("id", F.col("seq"))
    rows = rows.withColumn("co", F.when((F.col("seq") % 10 == 1) & (F.col("seq") % 3 == 0), 900).when(F.col("seq") % 10 == 1, 10).otherwise(0).cast("long"))
    rows = feed.check_in(rows, rows.where("seq % 10 = 0"))
    return feed.checkout(rows, 2, 1000, expire=500).select("seq", F.col("co").cast("long"))


@query(q("wd", TB, worksets("wd"), body="SELECT seq FROM ws WHERE ws % 7 = 0"))
def workset_group(s, d):
    some = s.range(256).where("id % 7 = 0").select(F.col("id").cast("int").alias("ws"))
    return jobs.group_rows(assignment.with_workset(v.wide(s, d)), some).select("seq")


# streams

@query("WITH " + LOOKED + " SELECT seq, u, id FROM ix UNION ALL SELECT seq + 1000000, u, id FROM ix WHERE f = 1")
def stream_seen_state(s, d):
    """Keyed state over two runs: pages, then pages again, of which only forced ones pass."""
    from spindrift.streaming import state

    root = scratch(s, "state")
    x = v.pages(s, d).select("seq", "u", "f")
    schema = "seq long, u string, f int"
    x.withColumn("f", F.lit(0)).repartition(2, "u").write.parquet(f"{root}/in")
    state.run(s, f"{root}/in", root, schema, 100)
    x.withColumn("seq", F.col("seq") + 1_000_000).coalesce(1).write.mode("append").parquet(f"{root}/in")
    return state.run(s, f"{root}/in", root, schema, 100).select("seq", "u", "id")


@query("WITH " + LINKED + " SELECT count(DISTINCT id) AS scheduled, count(DISTINCT id) AS seen FROM ix")
def stream_recovery(s, d):
    """A batch that failed after it scheduled and before it committed runs again."""
    from spindrift.streaming import dispatcher

    root = scratch(s, "recovery")
    rows = v.links(s, d).select("seq", "u")
    halves = [rows.where(F.col("seq") % 2 == k) for k in range(2)]
    dispatcher.dispatch_batch(halves[0], 0, root)
    dispatcher.dispatch_batch(halves[1], 1, root)
    dispatcher.drop(s, f"{root}/seen/delta/n=1")  # as if the process had ended before it
    for n, half in ((1, halves[1]), (0, halves[0])):
        dispatcher.dispatch_batch(half, n, root)
    done = s.read.parquet(f"{root}/scheduled").agg(F.count("*").alias("scheduled"))
    return done.join(dispatcher.seen_at(s, root, 2).agg(F.count("*").alias("seen")))


STREAMED = ",\n".join([SQL["wd"], TB, worksets("wd"), ided("ws", "wi")])


@query("WITH " + STREAMED + f", r AS (SELECT *, CASE WHEN ws % {v.CLIENTS} >= 12 THEN 'saved' WHEN seq % 9 = 0 THEN 'excluded' ELSE 'scheduled' END AS route FROM wi) SELECT route, ws, count(*) AS n FROM r GROUP BY ALL")
def stream_routed(s, d):
    """The whole dispatch in a stream, with its sinks by workset; every row comes twice."""
    from spindrift.streaming import dispatcher

    root = scratch(s, "routed")
    rows = v.wide(s, d)
    rows.repartition(2, "u").write.parquet(f"{root}/in")
    info = rows.where("seq % 9 = 0").select(F.concat(F.lit("c"), F.col("seq").cast("string"), F.lit(".com")).alias("domain"), F.lit(1).alias("exclude"))
    dims = lambda: {"wscl": assignment.default_wscl(s, v.CLIENTS), "active": s.range(12).select(F.col("id").cast("int").alias("client")), "info": info}
    dispatcher.run(s, f"{root}/in", root, "seq long, u string", files_per_batch=1, dims=dims)
    sinks = [s.read.parquet(f"{root}/{k}").select(F.lit(k).alias("route"), "ws") for k in ("saved", "excluded", "scheduled")]
    return reduce(lambda a, b: a.unionByName(b), sinks).groupBy("route", "ws").agg(F.count("*").alias("n"))


@query(q("pg", body=f"SELECT seq, u FROM pg WHERE f = 1 OR seq % 3 <> 0 OR seq % 6 = 0 EXCEPT ALL SELECT seq, u FROM pg WHERE {NEVER} < 0"))
def dispatch_lookup(s, d):
    """Lookup mode through the API: all clients active, nothing excluded."""
    from spindrift.api import Frontier

    rows = v.pages(s, d)
    old = rows.select(fp.frontier_id("u").alias("key"), "seq").where("seq % 3 = 0").select("key", F.when(F.col("seq") % 6 == 0, 50).otherwise(NEVER).cast("long").alias("e"))
    f = Frontier(s, assignment.default_wscl(s, 1), seen=old)
    out = f.dispatch_lookup(rows, s.range(1).select(F.col("id").cast("int").alias("client")), 100)["scheduled"]
    return out.join(rows.select("seq", "u"), "u").select("seq", "u")
