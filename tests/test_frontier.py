"""Vectors and small batches for the frontier operators."""

import gzip
import re
import struct

import pytest
from pyspark.sql import functions as F

from spindrift.api import Frontier
from spindrift.config import Config, Parameters, Parts
from spindrift.functions import urls
from spindrift.functions.fingerprint import POLY31, POLY32, fingerprint_bytes
from spindrift.functions.suffixes import RULES, known_rules, parse_rules, rule_pattern
from spindrift.operators import assignment, dispatch, feed, jobs, seen, status
from spindrift.sources import formats, queues
from spindrift.streaming import dispatcher


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "u string").select(f(F.col("u"))).first()[0]


@pytest.mark.parametrize("url,want", [
    ("http://example.org/", "org,example,"), ("http://user:pw@www.Example.org:8080/x", "org,Example,"), ("http://1.2.3.4/", "1.2.3.4"),
    ("http://www.a.com.sg/", "sg,com,a,"), ("http://www.a.co.il", "il,co,a,"), ("http://x.a.com.pl/", "pl,com,a,"), ("http://a.co.id/", "id,co,a,"), ("http://www.a.gouv.fr/", "fr,gouv,a,"),
    ("http://[2001:db8::7344]/", "[2001:db8::7344]"), ("http://[2001:db8::7344]:80/", "[2001:db8::7344]"), ("http://127.2.34.56/foo", "127.2.34.56"),
    ("http://www.a.com.au/", "au,com,a,"), ("http://www.v.co.uk/", "uk,co,v,"), ("http://www.assigned.public.tokyo.jp", "jp,tokyo,public,assigned,"),
    ("http://www.bad-site.de", "de,bad-site,"), ("http://sub.metro.tokyo.jp", "jp,tokyo,metro,"), ("http://metro.tokyo.jp", "jp,tokyo,metro,"), ("http://www.example.zzz", "zzz,example,"),
    ("http://1.2.3.4.example.com/", "1.2.3.4.example.com"),
    ("http://a.b.co.jp/", "jp,co,b,"), ("http://x.y.foo.uk/", "uk,foo,y,"), ("http://a.bl.uk/", "uk,bl,"), ("http://localhost/", "localhost"),
    ("http://www.city.x.tokyo.jp/", "jp,tokyo,x,city,"), ("http://a.metro.tokyo.jp/", "jp,tokyo,metro,"), ("nothing", "")])
def test_prefix(spark, url, want):
    assert one(spark, url, urls.domain_prefix) == want


@pytest.mark.parametrize("url,want", [
    ("http://www.example.org/a/B", "http://(org,example,www,)/a/b"), ("http://u@www.example.org:80/", "http://(org,example,www,:80@u)/"),
    ("http://u:p@www.example.org:80/m.php", "http://(org,example,www,:80@u:p)/m.php"), ("http://www.example.org", "http://(org,example,www,)"),
    ("http://www.example.org/m.php#top", "http://(org,example,www,)/m.php#top"), ("http://www.example.com/foo@bar", "http://(com,example,www,)/foo@bar"),
    ("http://10.0.0.1/x", "http://(10.0.0.1)/x"), ("no url", "no url"), ("http://a b.com/", "http://a b.com/"), ("http://[2001:db8::1]/x", "http://([2001:db8::1],)/x")])
def test_surt(spark, url, want):
    assert one(spark, url, urls.surt_form) == want


@pytest.mark.parametrize("url,want", [
    ("http://x.y/", "y,x,"), ("http://ai/", "ai,"), ("http://www.example.org:80/", "org,example,www,#80"), ("none", None)])
def test_core_key(spark, url, want):
    assert one(spark, url, urls.core_key) == want
    assert one(spark, "x://()y", urls.surt_authority) == "default..."


def test_reduced_keys_and_pattern(spark):
    cases = [
        ("com,example,www,", "com,example,"), ("com,example,", "com,example,"), ("fr,yy,www", "fr,yy,"), ("au,com,foobar,www,#80", "au,com,foobar,"),
        ("uk,co,v,www,", "uk,co,v,"), ("jp,tokyo,public,assigned,www,", "jp,tokyo,public,assigned,"), ("de,bad-site,www,", "de,bad-site,"), ("1.2.3.4", "1.2.3.4"),
        ("uk,bl,www,", "uk,bl,"), ("jp,tokyo,metro,subdomain,", "jp,tokyo,metro,"), ("zzz,example,www,", "zzz,example,"), ("example,", "example,"), ("default...", "default...")]
    df = spark.createDataFrame(cases, "k string, want string")
    assert all(r.got == r.want for r in df.select("want", urls.reduced_key(F.col("k")).alias("got")).collect())
    pattern = re.compile(rule_pattern())
    for key, want in cases:
        m = pattern.match(key)
        assert (m.group(0) if m else key) == want
    buckets = df.select(urls.legacy_bucket(F.col("k"), 20)).collect()
    assert buckets[0] == buckets[1] and all(0 <= b[0] < 20 for b in buckets)
    assert ("sg,com", "normal") in known_rules() and set(RULES) <= set(known_rules())


def test_long_keys(spark):
    url = "http://example.com/" + "a" * 900 + "?" + "b" * 900
    k = one(spark, url, urls.split_key)
    assert (k.u1 + k.u2, len(k.u1)) == (url, 790) and k.h == "#%x" % (fingerprint_bytes(k.u2.encode(), POLY32, 32) >> 32)
    assert tuple(one(spark, "http://e.com/", urls.split_key)) == ("http://e.com/", None, "")
    p = one(spark, url, urls.key_parts)
    assert p.path == "#%x" % fingerprint_bytes(p.long_path.encode()) and p.query == "#%x" % fingerprint_bytes(p.long_query.encode())
    assert one(spark, url, lambda c: urls.url_of_parts(urls.key_parts(c))) == url
    for u in ("http://e.com/x?y", "e", "//h/x", "http://h"):
        assert one(spark, u, lambda c: urls.url_of_parts(urls.key_parts(c))) == u and one(spark, u, lambda c: urls.joined_url(urls.split_key(c))) == u
    key = one(spark, "http://www.example.com/x", urls.lookup_key)
    assert key.fp == fingerprint_bytes(b"www.example.com", POLY31, 31) >> 33 and one(spark, "nohost", urls.shard_hash) == fingerprint_bytes(b"", POLY31, 31) >> 33
    assert tuple(one(spark, "http://e.com/", urls.hashed_key)) == ("#%x" % fingerprint_bytes(b"http://e.com/"), "http://e.com/")


def test_priority_and_schemes(spark):
    for p, want in (("", 0), (None, 0), ("R", 1), ("LE", 2), ("I", 2), ("L", 3), ("X", 3)):
        assert one(spark, p, urls.priority) == want
    assert one(spark, ":x", urls.scheme_ok) is False and one(spark, "ftp://x", urls.scheme_ok) is True


def test_rules():
    assert parse_rules("// c\n\nCOM // x\n*.uk\n!bl.uk") == [("com", "normal"), ("uk", "wildcard"), ("uk,bl", "exception")]


def batch(spark, hosts, start=0):
    return spark.createDataFrame([(start + i, f"http://{h}.com/", 0) for i, h in enumerate(hosts)], "seq long, u string, f int")


def test_dispatch_counts_and_rerun(spark):
    hosts = [f"h{i}" for i in range(100)]
    active = spark.createDataFrame([(0,)], "client int")
    f = Frontier.create(spark)
    first = f.dispatch(batch(spark, hosts[:50]), active)
    assert first["counters"].first().scheduled == 50
    f.seen_set = spark.createDataFrame(first["seen"].collect(), "key long, ts long")
    doubled = f.dispatch(batch(spark, hosts + hosts[:25] + hosts[60:80]), active)
    c = doubled["counters"].first()
    assert (c.processed, c.scheduled, c.seen, c.saved) == (145, 50, 95, 0)
    rows = doubled["scheduled"].select("seq").collect()
    assert sorted(r.seq for r in rows) == list(range(50, 100))
    f.seen_set = spark.createDataFrame(doubled["seen"].collect(), "key long, ts long")
    assert f.count_seen() == 100 and f.dispatch(batch(spark, hosts), active)["counters"].first().scheduled == 0
    nobody = spark.createDataFrame([], "client int")
    assert f.dispatch(batch(spark, hosts[:10]), nobody)["counters"].first().saved == 10
    forced = batch(spark, hosts[:3]).withColumn("f", F.lit(1))
    assert f.dispatch(forced, active)["counters"].first().scheduled == 3
    assert f.seen(batch(spark, ["h1", "zz"])).where("seen").count() == 1
    f.clear_seen()
    assert f.count_seen() == 0
    with pytest.raises(ValueError):
        f.dispatch(spark.range(1), active)


def test_exclusion_depth(spark, monkeypatch):
    info = spark.createDataFrame([("example.org", 1), ("www.shop.com", 0), ("shop.com", 1), (None, 1)], "domain string, exclude int")
    rows = spark.createDataFrame([(1, "http://www.example.org:80/"), (2, "http://www.shop.com/"), (3, "http://x.org/"), (4, "http://u@example.org/"), (5, None)], "id int, u string")
    from spindrift.operators import domains

    want = {1: 1, 2: 0, 3: None, 4: None, 5: None}
    found = domains.with_domain_info(rows, info)
    assert {r.id: r.exclude for r in found.collect()} == want
    assert "Exchange hashpartitioning" not in found._jdf.queryExecution().explainString(found._jdf.queryExecution().executedPlan() and spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")).split("BroadcastExchange")[0]
    monkeypatch.setattr(domains, "BROADCAST_DOMAINS", 0)
    assert {r.id: r.exclude for r in domains.with_domain_info(rows, info).collect()} == want
    assert domains.with_domain_info(rows, info.limit(0)).where("exclude is null").count() == 5


def simulate(rows, n, cursor, w):
    """Step by step: visit worksets in turn, a chunk each, until n rows or a full idle round."""
    left = {k: [s for i, s in rows if i == k] for k in range(w)}
    out, idle, chunk = [], 0, n // 4 + 1
    while len(out) < n and idle < w:
        got, left[cursor] = left[cursor][:chunk], left[cursor][chunk:]
        out += [(cursor, s) for s in got]
        idle = 0 if got else idle + 1
        cursor = (cursor + 1) % w
    return out


@pytest.mark.parametrize("n,cursor", [(5, 0), (8, 2), (40, 1), (100, 3)])
def test_feed_equals_simulation(spark, n, cursor):
    rows = [(k, k * 100 + i) for k, size in enumerate((7, 0, 30, 2)) for i in range(size)]
    got = feed.feed(spark.createDataFrame(rows, "ws_index int, seq long"), n, cursor, 4).orderBy("pos").collect()
    assert [(r.ws_index, r.seq) for r in got] == simulate(rows, n, cursor, 4)


def test_seen_files(spark, tmp_path):
    path = tmp_path / "SEEN"
    keys = [(-5, 0), (3, 2**32 - 1), (9, 7)]
    path.write_bytes(b"".join(struct.pack("<qI", *k) for k in keys))
    assert sorted(tuple(r) for r in formats.read_seen(spark, str(path)).collect()) == keys
    path.write_bytes(path.read_bytes() + b"xyz")
    assert sorted(tuple(r) for r in formats.read_seen(spark, str(path)).collect()) == keys
    df = spark.createDataFrame(keys, "key long, ts long")
    assert sorted(bytes(r[0]) for r in df.select(formats.pack_seen(df)).collect()) == sorted(struct.pack("<qI", *k) for k in keys)
    r = seen.integrity(spark.createDataFrame([(1, 5), (2, 4), (3, 4), (4, 9)], "pos long, key long")).first()
    assert (r.records, r.out_of_order, r.duplicates, r.first, r.last, r.ok) == (4, 1, 1, 5, 9, False)


def test_queue_files(spark, tmp_path):
    lines = [' {"u":"http://a/"}', '#{"u":"http://b/"}', " {bad", ' {"p":"L"}', ' {"u":"http://c/","zz":1}']
    with gzip.open(tmp_path / "100.gz", "wt") as f:
        f.write("\n".join(lines[:3]) + "\n")
    (tmp_path / "101").write_text("\n".join(lines[3:]) + "\n")
    (tmp_path / "102.open").write_text(lines[0] + "\n")
    got = formats.read_queue(spark, str(tmp_path), "10[01]*").select("u").collect()
    assert sorted(r.u for r in got) == ["http://a/", "http://c/"]
    assert [one(spark, t, formats.parse_bool) for t in ("true", "FALSE", "0", "2", "x", "")] == [True, False, False, True, True, False]


def test_stream_replays_without_duplicates(spark, tmp_path):
    root = f"file://{tmp_path}"
    rows = batch(spark, [f"s{i}" for i in range(50)])
    rows.unionByName(rows.limit(20)).repartition(4).write.parquet(f"{root}/in")
    schema = "seq long, u string, f int"
    assert dispatcher.run(spark, f"{root}/in", root, schema, compact_every=3).count() == 50
    # a batch that ran before its commit runs again, and writes the same
    again = spark.createDataFrame(spark.read.parquet(f"{root}/scheduled/batch=3").select("seq", "u", "f").collect(), schema)
    dispatcher.dispatch_batch(again, 3, root, compact_every=3)
    assert spark.read.parquet(f"{root}/scheduled").count() == 50 and dispatcher.seen_at(spark, root, 4).count() == 50
    assert [p.name for p in (tmp_path / "seen" / "base").iterdir() if not p.name.startswith(".")] == ["n=3"]
    batch(spark, [f"s{i}" for i in range(40, 60)]).coalesce(1).write.mode("append").parquet(f"{root}/in")
    assert dispatcher.run(spark, f"{root}/in", root, schema, compact_every=3).count() == 60
    assert dispatcher.seen_at(spark, root, 5).count() == 60


def test_stream_routes_and_reactivates(spark, tmp_path):
    root = f"file://{tmp_path}"
    rows = batch(spark, [f"r{i}" for i in range(60)])
    rows.coalesce(1).write.parquet(f"{root}/in")
    wscl = assignment.default_wscl(spark, 3)
    active = [0]
    dims = lambda: {"wscl": wscl, "active": spark.createDataFrame([(c,) for c in active], "client int"),
                    "info": spark.createDataFrame([("r1.com", 1), ("r2.com", 1)], "domain string, exclude int")}
    schema = "seq long, u string, f int"
    dispatcher.run(spark, f"{root}/in", root, schema, dims=dims)
    c = spark.read.parquet(f"{root}/counters/n=0").first()
    assert c.processed == 60 == c.excluded + c.saved + c.scheduled and c.saved == spark.read.parquet(f"{root}/saved").count() > 0
    active.append(1)  # read again by the next batch
    n = dispatcher.reactivate(spark, root, wscl, spark.createDataFrame([(1,)], "client int"), f"{root}/in2")
    assert n + spark.read.parquet(f"{root}/saved").count() == c.saved and spark.read.parquet(f"{root}/in2").where("prio = 0").count() == n
    spark.read.parquet(f"{root}/in2").select("seq", "u", "f").coalesce(1).write.mode("append").parquet(f"{root}/in")
    dispatcher.run(spark, f"{root}/in", root, schema, dims=dims)
    c = spark.read.parquet(f"{root}/counters/n=1").first()
    assert (c.processed, c.saved, c.scheduled + c.excluded) == (n, 0, n)


def test_feed_and_api(spark, tmp_path):
    f = Frontier.create(spark, clients=2)
    rows = f.schedule(batch(spark, [f"a{i}" for i in range(40)]))
    got = f.feed(rows, 0, 10).orderBy("pos").collect()
    assert len(got) >= 10 and all(r.ws % 2 == 0 for r in got) and [r.pos for r in got] == list(range(1, len(got) + 1))
    assert f.feed(rows, 0, 0).count() == f.feed(rows, -1, 5).count() == f.feed(rows, 9, 5).count() == 0
    cursor = feed.next_cursor(f.feed(rows, 0, 10), 128).first().cursor
    assert cursor == (got[-1].ws_index + 1) % 128
    assert f.finished(rows.select("seq", "u")).agg(F.sum("finished")).first()[0] == 40
    lines = spark.createDataFrame([('[{"u": "http://a/", "p": "L"}, "http://b/"]',), ('{"f": 1, "u": ["http://c/", {"u": "http://d/"}]}',), ("junk",), ("[]",), ('[{"p": "x"}]',), (None,)], "value string")
    assert sorted((r.u, r.p, r.f) for r in f.discovered(lines).collect()) == [("http://a/", "L", 0), ("http://b/", None, 0), ("http://c/", None, 1), ("http://d/", None, 1)]
    assert f.discover("http://a/", force=True).first().f == 1
    with pytest.raises(ValueError):
        f.discover("")
    f.seen_set = spark.createDataFrame([(1, 2), (1, 5)], "key long, ts long")
    f.repair_seen(spark.createDataFrame([(1, 9), (2, 0)], "key long, ts long"))
    assert sorted(tuple(r) for r in f.seen_set.collect()) == [(1, 9), (2, 0)]
    assert seen.lookup(f.seen_set, [2, 3]).count() == 1
    f.rebuild_seen(spark.createDataFrame([("t 200 5 http://x/ L v text/html #1 20120102030405+1 sha1:x - -",)] * 2, "value string"))
    assert f.count_seen() == 1
    assert f.param("frontier.servers") == 1 and f.param("frontier.servers", "3") == (3, 1) and f.servers == 3
    f.reload_info(lambda: spark.createDataFrame([("z.com", 1)], "domain string, exclude int"))
    assert f.info.count() == 1 and f.reset(0) and f.flush() is None
    f.mode = "lookup"
    with pytest.raises(ValueError):
        f.dispatch(batch(spark, ["q"]), spark.createDataFrame([(0,)], "client int"))


def test_config_and_parts(tmp_path):
    path = tmp_path / "c.ini"
    path.write_text("[feed]\nn = 9\n[x]\ny = true\n")
    c = Config({"a.b": "2.5"}, str(path))
    assert (c.getint("feed.n"), c.getfloat("a.b"), c.getbool("x.y"), c.get("no"), c.get("dispatcher.mode")) == (9, 2.5, True, None, "merge")

    class Thing:
        PARAMS = (("n", int), ("on", bool))
        n, on = 1, False

    p = Parameters({"thing": Thing()})
    assert p.set("thing.n", "5") == (5, 1) and p.get("thing.n") == 5 and p.set("thing.on", "TRUE") == (True, False) and p.set("thing.on", "0")[0] is False
    for bad in ("thing", "thing.zz", "no.n", "thing.n.x"):
        with pytest.raises(ValueError):
            p.get(bad)
    with pytest.raises(ValueError):
        p.set("thing.n", "x")
    parts = Parts(queue=lambda n: [n])
    assert parts.single("queue", 1) is parts.single("queue", 2) and parts.make("queue", 3) == [3]
    parts.replace(queue=lambda n: n)
    assert parts.make("queue", 4) == 4
    with pytest.raises(KeyError):
        parts.make("none")


def test_jobs(spark, tmp_path):
    none = spark.createDataFrame([], "name string, wscl array<int>, changed long")
    table = jobs.create_job(spark, none, "wide", clients=3)
    assert jobs.get_job(table, "wide").where("client = ws % 3").count() == 256
    for bad, error in (("wide", ValueError), ("x", ValueError), ("9x", ValueError)):
        with pytest.raises(error):
            jobs.create_job(spark, table, bad)
    with pytest.raises(KeyError):
        jobs.get_job(table, "none")
    with pytest.raises(ValueError):
        jobs.create_job(spark, table, "fine", clients=0)
    snapshot = f"file://{tmp_path}/jobs"
    assert jobs.load_jobs(spark, lambda: table, snapshot).count() == 1
    down = lambda: spark.read.parquet(f"file://{tmp_path}/none")
    assert jobs.load_jobs(spark, down, snapshot).first().name == "wide"
    sj = spark.createDataFrame([("s", "wide", 0)], "server string, job string, ts long")
    assert jobs.publish_job(sj, "s", "wide", 500).first().ts == 0 and jobs.publish_job(sj, "s", "wide", 700).first().ts == 700
    assert jobs.publish_alive(spark.createDataFrame([("s", 1)], "name string, ts long"), "s", 9).first().ts == 9
    names = spark.createDataFrame([("a",), ("a1B",), ("1a",), ("a-b",), ("",)], "n string").select(jobs.valid_name(F.col("n")))
    assert [r[0] for r in names.collect()] == [True, True, False, False, False]


def test_queue_directory(spark, tmp_path):
    (tmp_path / "prio=1").mkdir()
    (tmp_path / "prio=0").mkdir()
    for name, urls_ in (("prio=1/100", ["c"]), ("prio=0/300", ["b"]), ("prio=0/200", ["a", "a2"]), ("prio=0/100", []), ("prio=0/400.open", ["open"]), ("prio=0/x500", ["not"])):
        (tmp_path / name).write_text("".join(f' {{"u":"{u}"}}\n' for u in urls_))
    path = f"file://{tmp_path}"
    assert sorted(r.file for r in queues.segments(spark, path).collect()) == ["100", "200", "300"]  # none without content
    assert [(r.prio, r.segments) for r in queues.priorities(spark, path).collect()] == [(0, 2), (1, 1)]
    assert sorted(r.u for r in queues.bulk_read(spark, path).collect()) == ["a", "a2"]
    taken = spark.createDataFrame([("200",)], "file string")
    assert [r.u for r in queues.bulk_read(spark, path, taken).collect()] == ["b"]
    assert [r.u for r in feed.priority_order(queues.read_directory(spark, path)).collect()] == ["a", "a2", "b", "c"]
    everything = spark.createDataFrame([(n,) for n in ("100", "200", "300")], "file string")
    assert queues.bulk_read(spark, path, everything).count() == 0
    inq = queues.IncomingQueue(spark, f"{path}/inq")
    assert inq.add(spark.createDataFrame([("http://a/",)], "u string")) == 1


def test_queue_stream_takes_files_away(spark, tmp_path):
    source = tmp_path / "q"
    source.mkdir()
    for n in range(3):
        (source / f"10{n}").write_text(f' {{"u":"u{n}"}}\n#{{"u":"old"}}\n')
    stream = queues.stream_queue(spark, f"file://{source}", max_bytes="20", clean="delete")
    q = stream.select("u").writeStream.option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start(path=f"file://{tmp_path}/out", format="parquet")
    q.awaitTermination()
    assert sorted(r.u for r in spark.read.parquet(f"file://{tmp_path}/out").collect()) == ["u0", "u1", "u2"]


def test_submit_counts_what_failed(spark):
    def send(rows):
        if rows[0]["seq"] == 0:
            raise OSError("down")
        return len(rows) < 10

    out = status.submit(batch(spark, [f"h{i}" for i in range(25)]).coalesce(1), send, 10).collect()
    assert [(r.rows, r.sent) for r in out] == [(10, 0), (10, 0), (5, 5)]


def test_seen_versions_and_windows(spark, tmp_path):
    keys = [-5, 3, 9]
    (tmp_path / "v1").write_bytes(b"".join(struct.pack("<q", k) for k in keys) + b"xy")
    assert sorted(tuple(r) for r in formats.read_seen(spark, str(tmp_path / "v1"), version=1).collect()) == [(k, 0) for k in keys]
    formats.WHOLE_BYTES, before = 10, formats.WHOLE_BYTES
    (tmp_path / "v2").write_bytes(b"".join(struct.pack("<qI", k, 2**32 - 1) for k in keys))
    assert sorted(tuple(r) for r in formats.read_seen(spark, str(tmp_path / "v2")).collect()) == [(k, 2**32 - 1) for k in keys]
    formats.WHOLE_BYTES = before
    gaps = spark.createDataFrame([(1, 5), (3 << 20, 4), (9 << 20, 4), (1 << 40, 9)], "pos long, key long")
    r = seen.integrity(gaps).first()
    assert (r.records, r.out_of_order, r.duplicates, r.first, r.last, r.ok) == (4, 1, 1, 5, 9, False)
    assert seen.integrity(gaps.limit(0)).first().records == 0


def test_assignment_and_status(spark):
    wscl = assignment.default_wscl(spark, 3)
    assert wscl.count() == 256 and assignment.client_worksets(wscl).count() == 3
    with pytest.raises(ValueError):
        assignment.default_wscl(spark, 0)
    jobs = spark.createDataFrame([("ok", [0, 1] * 128), ("short", [0])], "name string, wscl array<int>")
    assert [(r.name, r.clients) for r in assignment.valid_wscl(jobs).collect()] == [("ok", 2)]
    x = status.transitions(spark.createDataFrame([(1, 0), (1, 40_000), (1, 40_100)], "client int, ts long")).orderBy("ts")
    assert [r.activates for r in x.collect()] == [True, True, False]
    t = spark.createDataFrame([(10, 0), (10, 5)], "n int, t int").select(status.per_second(F.col("n"), F.col("t")).alias("r"))
    assert [r.r for r in t.collect()] == [0.0, 2.0]
    assert dispatch.active_clients(spark.sql("select 1 client, timestamp'2024-01-01' last_feed union all select 2, timestamp'2024-01-02'"), "2024-01-02 05:00:00").collect() == [(2,)]


def test_commands(spark, tmp_path, capsys):
    from spindrift import commands

    p = f"file://{tmp_path}"
    (tmp_path / "seeds").write_text("# none\na.com\nhttp://b.org/x\nmailto://c\n\n")
    r = commands.schedule(spark, "seed", f"{p}/seeds", f"{p}/queue", force=True).first()
    assert (r["count"], r.dropped, r.ignored) == (2, 1, "mailto")
    assert sorted((x.u, x.f) for x in formats.read_queue(spark, f"{p}/queue").collect()) == [("http://a.com/", 1), ("http://b.org/x", 1)]
    with pytest.raises(ValueError):
        commands.schedule(spark, "none", f"{p}/seeds", f"{p}/queue")
    with pytest.raises(ValueError):
        commands.schedule(spark, "seed", f"{p}/seeds", f"{p}/queue", job="9")
    n = commands.novelty(spark, f"{p}/queue").first()
    assert (n.distinct_ids, n.novelty) == (2, 1.0) and commands.hashes(spark, f"{p}/queue").distinct().count() == 2
    assert commands.split(spark, f"{p}/queue", f"{p}/windows").agg(F.sum("rows")).first()[0] == 2
    owned = {x.server: x.rows for x in commands.shuffle(spark, f"{p}/queue", f"{p}/shuffled", -1, [0, 1, 2, 3, 4], 5).collect()}
    assert sum(owned.values()) == 2
    (tmp_path / "v1").write_bytes(struct.pack("<3q", 1, 5, 9))
    (tmp_path / "v2").write_bytes(struct.pack("<qIqI"[0:1] + "qI", 5, 7) + struct.pack("<qI", 5, 9))
    assert commands.seen_check(spark, f"{p}/v1", 1).first().ok is True and commands.seen_check(spark, f"{p}/v2").first().duplicates == 1
    assert commands.seen_convert(spark, f"{p}/v1", f"{p}/t1").first().records == 3
    assert commands.seen_repair(spark, f"{p}/t2", f"{p}/v2", f"{p}/v2").first().records == 1
    assert commands.seen_dump(spark, f"{p}/v2", f"{p}/text").first().records == 2
    (tmp_path / "log").write_text("t 200 5 http://x/ L v text/html #1 20120102030405+1 sha1:x - -\n")
    assert commands.seen_rebuild(spark, f"{p}/log", f"{p}/t3").first().records == 1
    (tmp_path / "rules").write_text("// a\n*.uk\n!bl.uk\n")
    assert re.match(commands.public_suffixes(spark, f"{p}/rules").first().pattern, "uk,bl,www,").group(0) == "uk,bl,"
    assert commands.main(["novelty", f"{p}/queue"]) == 0 and '"distinct_ids":2' in capsys.readouterr().out
    assert commands.main(["none"]) == 2


def test_compression_by_batch(spark):
    rows = batch(spark, [f"same{i % 2}" for i in range(40)]).withColumn("b", F.col("seq") % 2)
    r = status.compression(rows, batch="b").collect()
    assert len(r) == 2 and all(x.ratio < 0.5 for x in r)
