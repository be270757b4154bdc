"""Mixing sources to target weights by hierarchical budgets.

Leaves are the sources of a language of a domain. A budget of tokens flows down the tree:
each node shares its budget among its children by weight, no child gets more than its
subtree can supply (its tokens times the epochs allowed), and what a child can't take
goes to its siblings; only what a whole family can't take remains for the family's own
siblings, because a family's supply bounds what its parent gives it. Shares are whole
tokens; what rounding down leaves goes to the children of the largest remainders, one each.

A leaf whose budget is q times its tokens and a rest takes q whole epochs and, of epoch
q, the prefix whose tokens reach the rest, in an order seeded per epoch. The place of a
prefix's end is found in two steps, so that no leaf's documents meet in one task: sums
per bucket of the order key, then the documents of the single bucket in which it ends.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spindrift.llm.common import WORD, materialize

LEVELS = ["domain", "lang", "source"]
#: Leaves up to which their ends are broadcast; beyond, the join shuffles.
BROADCAST_LEAVES = 100_000
#: Hexadecimal digits of the order key that name a bucket, at least.
_BUCKET_DIGITS = 3


def _weight(level: str, weights: dict[str, dict[str, int]]) -> Column:
    known = weights.get(level, {})
    out = F.lit(1)
    for name, w in known.items():
        out = F.when(F.col(level) == name, F.lit(w)).otherwise(out)
    return out.cast("long")


def allocate(leaves: DataFrame, budget: int, weights: dict[str, dict[str, int]], max_epochs: int, levels: list[str] = LEVELS) -> DataFrame:
    """Budgets of leaves. ``leaves``: the levels and ``tokens``; appends ``share``."""
    nodes = leaves.withColumn("cap", F.col("tokens") * max_epochs)
    given: DataFrame | None = None
    for depth, level in enumerate(levels, 1):
        keys, parent = levels[:depth], levels[: depth - 1]
        kids = nodes.groupBy(*keys).agg(F.sum("cap").alias("cap")).withColumn("w", _weight(level, weights))
        kids = kids.withColumn("budget", F.lit(budget).cast("long")) if given is None else kids.join(given, parent)
        w = W.partitionBy(*(parent or [F.lit(0)]))
        ranked = w.orderBy(F.col("cap") / F.col("w"), level)
        before = F.coalesce(F.sum("cap").over(ranked.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        kids = kids.withColumn("full", F.col("cap") * F.sum("w").over(ranked.rowsBetween(0, W.unboundedFollowing)) <= F.col("w") * (F.col("budget") - before))
        rest = F.col("budget") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(w)
        open_w = F.sum(F.when(F.col("full"), 0).otherwise(F.col("w"))).over(w)
        kids = kids.withColumns({"rest": rest, "open_w": open_w})
        kids = kids.withColumn("part", F.expr("if(full, 0, (w * rest) div greatest(open_w, 1))"))
        kids = kids.withColumn("over", F.expr("if(full, -1, (w * rest) % greatest(open_w, 1))"))
        kids = kids.withColumn("left", F.expr("if(open_w > 0, rest, 0)") - F.sum("part").over(w))
        extra = (F.row_number().over(w.orderBy(F.desc("over"), level)) <= F.col("left")) & ~F.col("full")
        given = kids.select(*keys, F.when(F.col("full"), F.col("cap")).otherwise(F.col("part") + extra.cast("long")).alias("budget"))
    return leaves.join(given, levels).withColumnRenamed("budget", "share")


def order_key(seed: int, epoch: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).cast("binary"))


def plan(docs: DataFrame, weights: dict[str, dict[str, int]], budget_share: tuple[int, int], max_epochs: int, seed: int, levels: list[str] = LEVELS) -> DataFrame:
    """Per leaf: whole epochs ``q`` and ``cut``, the last order key that epoch q takes.

    ``docs``: doc_id, the levels and n_tokens. The budget is the share a/b of all tokens.
    """
    leaves = materialize(docs.groupBy(*levels).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows")), "leaves")
    total, most = (x or 0 for x in leaves.agg(F.sum("tokens"), F.max("rows")).first())
    # as many buckets as documents in one, so that neither step is long for the largest leaf
    digits = max(_BUCKET_DIGITS, math.ceil(math.log(max(1, most), 16) / 2))
    leaves = leaves.drop("rows")
    shares = materialize(
        allocate(leaves, total * budget_share[0] // budget_share[1], weights, max_epochs, levels)
        .withColumn("q", F.when(F.col("tokens") > 0, F.expr("share div tokens")).otherwise(0).cast("long"))
        .withColumn("r", F.col("share") - F.col("q") * F.col("tokens")),
        "shares",
    )
    # documents with equal keys (repeats of an id) are taken together
    keyed = with_leaves(docs, shares.select(*levels, "q", "r"), levels).where("r > 0")
    keyed = keyed.withColumn("h", order_key(seed, F.col("q")))
    keyed = keyed.withColumn("bucket", F.substring("h", 1, digits))
    sums = keyed.groupBy(*levels, "bucket").agg(F.sum("n_tokens").alias("n"), F.max("r").alias("r"))
    before = F.coalesce(F.sum("n").over(W.partitionBy(*levels).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # the last bucket that begins within the rest holds the prefix's end
    last = sums.withColumn("before", before).where("before < r").groupBy(*levels).agg(F.max_by(F.struct("bucket", "before"), "bucket").alias("b"))
    last = last.select(*levels, F.col("b.bucket").alias("bucket"), F.col("b.before").alias("before"))
    inside = keyed.join(last, [*levels, "bucket"]).groupBy(*levels, "h").agg(F.sum("n_tokens").alias("n"), F.max("r").alias("r"), F.max("before").alias("before"))
    seen = F.coalesce(F.sum("n").over(W.partitionBy(*levels).orderBy("h").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    cuts = inside.withColumn("seen", F.col("before") + seen).where("seen < r").groupBy(*levels).agg(F.max("h").alias("cut"))
    return shares.join(cuts, levels, "left").select(*levels, "q", "cut", "share", "tokens")


def with_leaves(docs: DataFrame, leaves: DataFrame, levels: list[str]) -> DataFrame:
    small = leaves.limit(BROADCAST_LEAVES + 1).count() <= BROADCAST_LEAVES
    return docs.join(F.broadcast(leaves) if small else leaves, levels)


def take(docs: DataFrame, planned: DataFrame, seed: int, levels: list[str] = LEVELS) -> DataFrame:
    """Rows of ``docs`` once for each epoch that takes them, with ``epoch``, which replaces a
    column of that name."""
    rows = docs.drop("epoch").select("doc_id", *levels, F.struct("*").alias("_row"))
    out = with_leaves(rows, planned.select(*levels, "q", "cut"), levels)
    n = F.col("q") + F.coalesce(order_key(seed, F.col("q")) <= F.col("cut"), F.lit(False)).cast("long")
    return out.withColumn("_n", n).where("_n > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1))).select("_row.*", "epoch")


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def domain_of(source: Column) -> Column:
    """The domain of a source of the test tables, by the number in its name."""
    n = F.regexp_extract(source, "([0-9]{1,15})$", 1)
    n = F.when(n != "", n).cast("long")
    return F.when(n % 3 == 0, "web").when(n % 3 == 1, "books").when(n % 3 == 2, "news").otherwise("other")


#: Production parameters of the query and of the pipeline.
WEIGHTS = {"domain": {"web": 5, "books": 3, "news": 2}, "lang": {"en": 4, "de": 2, "fr": 2, "es": 1}}
BUDGET_SHARE, MAX_EPOCHS, SEED = (3, 5), 2, 42


def leaf_columns(docs: DataFrame) -> DataFrame:
    """Append ``domain``; null languages and sources become leaves named ``none``."""
    return docs.withColumn("domain", domain_of(F.col("source"))).withColumns({c: F.coalesce(c, F.lit("none")) for c in ("lang", "source")})


def mix(docs: DataFrame) -> DataFrame:
    """The mixed sample of ``docs`` (doc_id, text, lang, source) with production parameters.

    One row per document and epoch. Tokens are words here. Empty and null texts have no
    token and are taken with the prefix that they stand in; leaves without tokens give
    nothing; repeated ids, and rows without one, share an order key and are taken together;
    null languages and sources are leaves of their own; other columns are not read; an
    empty table gives an empty table.
    """
    slim = leaf_columns(docs.select("doc_id", "lang", "source", count_words(F.col("text")).alias("n_tokens")))
    slim = materialize(slim, "mix")
    return take(slim, plan(slim, WEIGHTS, BUDGET_SHARE, MAX_EPOCHS, SEED), SEED)


def _oracle() -> str:
    def weight(level: str) -> str:
        whens = " ".join(f"WHEN {level} = '{k}' THEN {v}" for k, v in WEIGHTS.get(level, {}).items())
        return f"(CASE {whens} ELSE 1 END)::BIGINT" if whens else "1::BIGINT"

    sql = r"""WITH d AS (SELECT doc_id, coalesce(lang, 'none') AS lang, coalesce(source, 'none') AS source,
  coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS n_tokens,
  coalesce((['web', 'books', 'news'])[TRY_CAST(regexp_extract(source, '([0-9]{1,15})$', 1) AS BIGINT) % 3 + 1], 'other') AS domain FROM documents),
lv AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens FROM d GROUP BY ALL)"""
    for depth, level in enumerate(LEVELS, 1):
        keys, parent = ", ".join(LEVELS[:depth]), ", ".join(LEVELS[: depth - 1])
        by = f"PARTITION BY {parent} " if parent else ""
        budget = f"(SELECT sum(tokens)::BIGINT * {BUDGET_SHARE[0]} // {BUDGET_SHARE[1]} FROM lv)" if depth == 1 else "budget"
        source = f"(SELECT {keys}, sum(tokens)::BIGINT * {MAX_EPOCHS} AS cap FROM lv GROUP BY ALL)" + (f" JOIN s{depth - 1} USING ({parent})" if parent else "")
        sql += f""",
a{depth} AS (SELECT {keys}, cap, {weight(level)} AS w, {budget}::BIGINT AS b FROM {source}),
f{depth} AS (SELECT *, cap * sum(w) OVER ({by}ORDER BY cap / w, {level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
  <= w * (b - coalesce(sum(cap) OVER ({by}ORDER BY cap / w, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS sat FROM a{depth}),
r{depth} AS (SELECT *, b - sum(CASE WHEN sat THEN cap ELSE 0 END) OVER ({by}) AS rest, sum(CASE WHEN sat THEN 0 ELSE w END) OVER ({by}) AS ow FROM f{depth}),
o{depth} AS (SELECT *, CASE WHEN sat THEN 0 ELSE w * rest // greatest(ow, 1) END AS part, CASE WHEN sat THEN -1 ELSE w * rest % greatest(ow, 1) END AS rem FROM r{depth}),
s{depth} AS (SELECT {keys}, (CASE WHEN sat THEN cap ELSE part + (row_number() OVER ({by}ORDER BY rem DESC, {level}) <= rest - sum(part) OVER ({by}))::INT END)::BIGINT AS budget FROM o{depth})"""
    return sql + f""",
p AS (SELECT domain, lang, source, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS q, tokens, budget FROM lv JOIN s3 USING (domain, lang, source)),
k AS (SELECT d.*, q, budget - q * tokens AS r, md5('{SEED}:' || q || ':' || coalesce(doc_id::VARCHAR, '-')) AS h FROM d JOIN p USING (domain, lang, source)),
c AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP), 0) AS seen FROM k),
n AS (SELECT *, q + (seen < r)::BIGINT AS times FROM c)
SELECT doc_id, domain, lang, source, n_tokens, unnest(range(times))::BIGINT AS epoch FROM n WHERE times > 0"""


ORACLE = _oracle()
