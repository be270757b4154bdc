"""URL scalars in built-in column functions: hosts, prefixes, SURT forms, keys, priorities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spindrift.functions import fingerprint as fp
from spindrift.functions.suffixes import registered

SCHEMES = ["http", "https", "ftp"]
_NETLOC = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)"


def host(url: Column) -> Column:
    """Network location without user information and port; empty where there is none. A
    bracketed address keeps its colons."""
    return F.regexp_replace(F.regexp_replace(F.regexp_extract(url, _NETLOC, 1), r"^.*@", ""), r":\d+$", "")


def domain_prefix(url: Column, rules: list[tuple[str, str]] | None = None) -> Column:
    """Reversed registered domain with a comma after each label.

    Hosts of one label, with a label that is not ASCII word characters or hyphens, or
    that begin with a dotted quad, are returned as they are. Case is kept.
    """
    h = host(url)
    plain = h.rlike(r"^[-\w]+(\.[-\w]+)+$") & ~h.rlike(r"^\d+(\.\d+){3}")
    return F.when(plain, registered(F.reverse(F.split(h, r"\.")), rules)).otherwise(h)


#: Fixed value: scheme, user information, address or name, port, and path of a URL.
_SURT = r"^(\w+://)(?:([-\w.!~*'()%;:&=+$,]+?)@)?(?:((?:\d{1,3}\.){3}\d{1,3})|(\S+?))(:\d+)?(/\S*)?$"


def surt_form(url: Column, preserve_case: bool = False) -> Column:
    """``scheme://(reversed,host,[:port][@user])path``; addresses keep their order. What has
    another form, as a string with spaces, is returned as it is."""
    scheme, user, quad, name, port, path = (F.regexp_extract(url, _SURT, i) for i in range(1, 7))
    turned = F.when(quad != "", quad).otherwise(F.concat(F.array_join(F.reverse(F.split(name, r"\.")), ","), F.lit(",")))
    at = F.when(user != "", F.concat(F.lit("@"), user)).otherwise("")
    out = F.concat(scheme, F.lit("("), turned, port, at, F.lit(")"), path)
    return F.when(url.rlike(_SURT), out if preserve_case else F.lower(out)).otherwise(url)


def surt_authority(surt: Column) -> Column:
    """What stands between ``://(`` and the next ``)``; ``default...`` where that is empty,
    null where a mark is missing."""
    inner = F.regexp_extract(surt, r"://\(([^)]*)\)", 1)
    return F.when(surt.rlike(r"://\([^)]*\)"), F.when(inner == "", "default...").otherwise(inner))


def core_key(url: Column) -> Column:
    return F.replace(surt_authority(surt_form(url)), F.lit(":"), F.lit("#"))


def reduced_key(key: Column, rules: list[tuple[str, str]] | None = None) -> Column:
    """A core key cut to its registered domain; keys of one label, and addresses, as they are."""
    labels = F.regexp_extract(key, r"^((?:[-\w]+,){2,})", 1)
    cut = registered(F.slice(F.split(labels, ","), 1, F.size(F.split(labels, ",")) - 1), rules)
    return F.when(labels != "", cut).otherwise(key)


def legacy_bucket(key: Column, buckets: int, rules: list[tuple[str, str]] | None = None) -> Column:
    """Bucket of a core key: the key is cut to its registered domain; the magnitude of its
    character-wise fingerprint is taken modulo the number of buckets."""
    f = fp.fingerprint_charwise(reduced_key(key, rules))
    # the least long has no magnitude among longs: 2^63 mod n
    least = F.lit((1 << 63) % buckets)
    return F.when(f == F.lit(-(1 << 63)), least).otherwise(F.abs(f) % buckets).cast("int")


def priority(path: Column) -> Column:
    """0 for no hop path; by its last letter 1 for R, 2 for E and I, 3 for others."""
    last = F.right(path, F.lit(1))
    return F.when(F.coalesce(path, F.lit("")) == "", 0).when(last == "R", 1).when(last.isin("E", "I"), 2).otherwise(3)


def scheme_ok(url: Column) -> Column:
    return (F.locate(":", url) > 1) & F.substring_index(url, ":", 1).isin(SCHEMES)


def with_default_scheme(url: Column) -> Column:
    return F.when(url.rlike("^https?://"), url).otherwise(F.concat(F.lit("http://"), url))


#: Characters of the first part of a long URL, and of a part that is hashed.
LONG_URL, LONG_PART = 790, 800


def _hex(f: Column) -> Column:
    """``#`` and the unsigned value in lower-case hexadecimal digits."""
    return F.concat(F.lit("#"), F.lower(F.hex(f)))


def split_key(url: Column, limit: int = LONG_URL) -> Column:
    """Key (u1, u2, h) of a URL: of a long one, the first ``limit`` characters, the rest, and
    the 32-bit fingerprint of the rest; else the URL, null and the empty string."""
    long = F.length(url) > limit
    rest = F.when(long, F.substr(url, F.lit(limit + 1)))
    h = F.when(long, _hex(F.shiftrightunsigned(fp.fingerprint_32(F.coalesce(rest, F.lit(""))), 32))).otherwise("")
    return F.when(url.isNotNull(), F.struct(F.substring(url, 1, limit).alias("u1"), rest.alias("u2"), h.alias("h")))


def joined_url(key: Column) -> Column:
    """The URL of a key of :func:`split_key`."""
    return F.concat(key["u1"], F.coalesce(key["u2"], F.lit("")))


def shard_hash(url: Column) -> Column:
    """Degree-31 hash of the host between ``://`` and the next slash, as a small integer."""
    return F.shiftrightunsigned(fp.host_hash(F.regexp_extract(url, "^.+?://([^/]*)", 1)), 33)


def lookup_key(url: Column) -> Column:
    """(fp, u1, h): what a sharded store is asked for."""
    k = split_key(url)
    return F.struct(shard_hash(url).alias("fp"), k["u1"].alias("u1"), k["h"].alias("h"))


def key_parts(url: Column, limit: int = LONG_PART) -> Column:
    """Scheme, host, path and query; a path or query of ``limit`` characters or more is
    replaced by its 64-bit fingerprint, and stands in ``long_path`` or ``long_query``."""
    part = [F.coalesce(F.regexp_extract(url, r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?", i), F.lit("")) for i in range(1, 5)]

    def short(x: Column) -> Column:
        return F.when(F.length(x) < limit, x).otherwise(_hex(fp.frontier_id(x)))

    def whole(x: Column) -> Column:
        return F.when(F.length(x) >= limit, x)

    return F.struct(F.lower(part[0]).alias("scheme"), part[1].alias("host"), short(part[2]).alias("path"), short(part[3]).alias("query"),
                    whole(part[2]).alias("long_path"), whole(part[3]).alias("long_query"))


def url_of_parts(key: Column) -> Column:
    """The URL, without fragment, of a key of :func:`key_parts`."""
    query = F.coalesce(key["long_query"], key["query"])
    return F.concat(F.when(key["scheme"] != "", F.concat(key["scheme"], F.lit(":"))).otherwise(""),
                    F.when(key["host"] != "", F.concat(F.lit("//"), key["host"])).otherwise(""),
                    F.coalesce(key["long_path"], key["path"]), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def hashed_key(url: Column) -> Column:
    """(h, u): the 64-bit fingerprint of a URL in hexadecimal digits, and the URL."""
    return F.struct(_hex(fp.frontier_id(url)).alias("h"), url.alias("u"))
