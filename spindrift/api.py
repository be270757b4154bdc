"""The frontier of one job: discovered, dispatched, fed and finished rows as DataFrames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.config import Config, Parameters
from spindrift.functions import urls
from spindrift.functions.fingerprint import frontier_id
from spindrift.operators import assignment, dispatch, feed, seen, status
from spindrift.schemas import SEEN, WORKSETS
from spindrift.sources import formats

ROWS = "u string, p string, v string, x string, f int"


class Frontier:
    """Holds the job's dimension tables; every method takes and returns DataFrames."""

    PARAMS = (("timeout", str), ("mode", str), ("servers", int))

    def __init__(self, spark: SparkSession, wscl: DataFrame, seen: DataFrame | None = None, info: DataFrame | None = None, config: Config | None = None):
        self.spark, self.wscl = spark, wscl
        self.config = config or Config()
        self.timeout, self.mode, self.servers = self.config.get("scheduler.timeout"), self.config.get("dispatcher.mode"), 1
        self.seen_set = seen if seen is not None else spark.createDataFrame([], SEEN)
        self.info = info if info is not None else spark.createDataFrame([], "domain string, exclude int")

    # submitting

    def discovered(self, lines: DataFrame) -> DataFrame:
        """Rows of submitted JSON bodies (value): lists of rows, or ``{f, u}`` of forced ones."""
        return formats.parse_discovered(lines)

    def discover(self, url: str, p: str | None = None, v: str | None = None, x: str | None = None, force: bool = False) -> DataFrame:
        """One submitted row; a URL is needed."""
        if not url:
            raise ValueError("a row needs a URL")
        return self.spark.createDataFrame([(url, p, v, x, int(force))], ROWS)

    def schedule(self, rows: DataFrame) -> DataFrame:
        """Rows that go straight to their worksets, with id, ws and client; nothing is checked."""
        placed = assignment.with_workset(rows.where("u is not null").withColumn("id", frontier_id("u")))
        return placed.join(F.broadcast(self.wscl), "ws", "left")

    def active(self, activity: DataFrame, now) -> DataFrame:
        return dispatch.active_clients(activity, now, self.timeout)

    def dispatch(self, rows: DataFrame, active: DataFrame) -> dict[str, DataFrame]:
        """Routes of a batch: scheduled, saved and excluded rows, counters and the next seen set.

        Mode ``merge`` keeps whole rows; mode ``lookup`` checks expiry (``e`` of the seen
        set) and gives rows that go out: u, id, p, v and x.
        """
        if "u" not in rows.columns:
            raise ValueError("rows need a column u")
        routed = dispatch.route(rows.where("u is not null"), self.wscl, active, self.info)
        candidates = routed.where("route = 'candidate'")
        if self.mode == "lookup":
            raise ValueError("mode lookup needs dispatch_lookup and a time")
        scheduled = dispatch.unseen(candidates, self.seen_set)
        return {
            "scheduled": scheduled, "saved": routed.where("route = 'saved'"), "excluded": routed.where("route = 'excluded'"),
            "counters": dispatch.counters(routed, self.seen_set), "seen": dispatch.merge_union(candidates, self.seen_set),
        }

    def dispatch_lookup(self, rows: DataFrame, active: DataFrame, now: int) -> dict[str, DataFrame]:
        """The lookup mode over a seen set (key, e): what is seen forever is not scheduled, what
        expired is, once. Rows that go out carry u, id and the hop fields."""
        need = {"f": "int", "p": "string", "v": "string", "x": "string", "w": "struct<p:string,v:string,x:string>", "seq": "long"}
        for c, kind in need.items():
            if c not in rows.columns:
                rows = rows.withColumn(c, F.monotonically_increasing_id() if c == "seq" else F.lit(None).cast(kind))
        routed = dispatch.route(rows.where("u is not null"), self.wscl, active, self.info)
        candidates = routed.where("route = 'candidate'")
        known = self.seen_set if "e" in self.seen_set.columns else self.seen_set.select("key", F.lit(dispatch.NEVER).cast("long").alias("e"))
        passed = dispatch.lookup_check(candidates, known, now)
        marked = dispatch.seen_record(candidates.where("coalesce(f, 0) = 0").select("id").distinct())
        after = known.join(marked.select("key"), "key", "left_anti").unionByName(marked)
        return {"scheduled": dispatch.hops(passed).select("ws", "client", "u", "id", "p", "v", "x"), "saved": routed.where("route = 'saved'"),
                "excluded": routed.where("route = 'excluded'"), "seen": after}

    # feeding

    def feed(self, scheduled: DataFrame, client: int, n: int, cursor: int = 0) -> DataFrame:
        """Rows for a client's request of n, in order ``pos``; none for n = 0, for a negative
        client, or for a client without worksets."""
        mine = assignment.client_worksets(self.wscl).where(F.col("client") == client)
        index = mine.select(F.posexplode("worksets").alias("ws_index", "ws"))
        worksets = index.count()
        rows = scheduled.join(F.broadcast(index), "ws")
        if n <= 0 or client < 0 or not worksets:
            return feed.feed(rows, 1, 0, max(1, worksets)).limit(0)
        return feed.feed(rows, n, cursor, worksets)

    def finished(self, rows: DataFrame) -> DataFrame:
        return feed.finished_by_workset(assignment.with_workset(rows))

    # the seen set

    def seen(self, rows: DataFrame) -> DataFrame:
        keys = self.seen_set.select(F.col("key").alias("id"), F.lit(True).alias("seen"))
        return rows.withColumn("id", frontier_id("u")).join(keys, "id", "left").withColumn("seen", F.coalesce("seen", F.lit(False)))

    def count_seen(self) -> int:
        return self.seen_set.count()

    def clear_seen(self) -> None:
        self.seen_set = self.seen_set.limit(0)

    def repair_seen(self, *parts: DataFrame) -> None:
        """One record a key, the latest, of the seen set and other parts of it."""
        self.seen_set = seen.repair(self.seen_set, *parts)

    def rebuild_seen(self, log_lines: DataFrame) -> None:
        """The seen set anew, from the lines of crawl logs."""
        self.seen_set = seen.rebuild(formats.parse_crawl_log(log_lines))

    # places and states

    def which(self, rows: DataFrame) -> DataFrame:
        """Workset and client of URLs; a scheme is put before bare hosts."""
        return assignment.with_workset(rows.withColumn("u", urls.with_default_scheme(F.col("u")))).join(F.broadcast(self.wscl), "ws", "left")

    def locate(self, rows: DataFrame, servers: DataFrame) -> DataFrame:
        return assignment.locate(rows, self.wscl, servers, self.servers)

    def status(self, worksets: DataFrame) -> DataFrame:
        """Client rows of (ws, scheduled, finished, files)."""
        return status.client_status(worksets.join(F.broadcast(self.wscl), "ws"))

    def workset_status(self, worksets: DataFrame) -> DataFrame:
        return status.workset_status(worksets)

    def reload_info(self, read: Callable[[], DataFrame]) -> None:
        self.info = read()

    def param(self, name: str, value: str | None = None):
        """Read ``frontier.name``, or set it: the new and the former value."""
        params = Parameters({"frontier": self})
        return params.get(name) if value is None else params.set(name, value)

    def flush(self) -> None:
        """Nothing is held back: what a method returned is written when it is written."""

    def reset(self, client: int) -> bool:
        """A client has no state of its own; true, as for any client."""
        return True

    @staticmethod
    def create(spark: SparkSession, clients: int = 1, worksets: int = WORKSETS) -> Frontier:
        return Frontier(spark, assignment.default_wscl(spark, clients, worksets))
