"""Domain information by the longest known suffix of a host."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of domain information up to which it is broadcast; beyond, the joins shuffle.
BROADCAST_DOMAINS = 1_000_000


def lookup_host(url: Column) -> Column:
    """Network location without port; user information is kept, so that such hosts miss."""
    return F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1), r":\d*$", "")


def with_domain_info(rows: DataFrame, info: DataFrame, url: str = "u") -> DataFrame:
    """Append ``domain`` and ``exclude`` of the deepest entry of ``info`` (domain, exclude)
    that is the host or a suffix of it; null where none is.

    Rows stay where they are: for each number of labels that entries have, the host's last
    labels are looked up in a broadcast table, and the deepest hit counts. Only where
    ``info`` is too large are these joins shuffled. Of entries of one domain the greatest counts.
    """
    side = info.where("domain is not null").groupBy("domain").agg(F.max("exclude").alias("exclude"))
    side = side.withColumn("labels", F.size(F.split("domain", r"\.")))
    depths = sorted((r.labels, r.n) for r in side.groupBy("labels").agg(F.count("*").alias("n")).collect())  # a row per number of labels
    small = sum(n for _, n in depths) <= BROADCAST_DOMAINS
    out = rows.withColumn("_labels", F.split(lookup_host(F.col(url)), r"\."))
    for depth, _ in depths:
        at = side.where(F.col("labels") == depth).select(F.col("domain").alias("_suffix"), F.struct("domain", "exclude").alias(f"_hit{depth}"))
        suffix = F.when(F.size("_labels") >= depth, F.array_join(F.slice("_labels", -depth, depth), "."))
        out = out.withColumn("_suffix", suffix).join(F.broadcast(at) if small else at, "_suffix", "left").drop("_suffix")
    none = F.lit(None).cast("struct<domain:string,exclude:int>")
    hit = F.coalesce(*(F.col(f"_hit{depth}") for depth, _ in reversed(depths)), none)
    return out.withColumns({"domain": hit["domain"], "exclude": hit["exclude"]}).drop("_labels", *(f"_hit{depth}" for depth, _ in depths))
