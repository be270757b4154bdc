"""Quality rules with risk-controlled thresholds, in DataFrame functions alone.

Each rule rejects a text when a ratio exceeds a cutoff. Per stratum (the language), the
cutoff is the lowest of a fixed list for which labelled good documents prove, by the
exact binomial tail, that at most a share ``RISK / rules`` of good documents is rejected:
the chance to see as few false rejections as were seen, were the share higher, must stay
under ``ERROR`` divided by the number of all tests (strata x rules x cutoffs). By the
union bound, all rules together reject at most ``RISK`` of a stratum's good documents,
in every stratum at once, with confidence 1 - ``ERROR``. A stratum without enough labels
gets no cutoff, and only the base rules judge its documents.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import WORD, materialize

RISK, ERROR = 0.05, 0.05
CUTOFFS = [0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5]
RULES = {
    "symbols": ("n_symbols", "word_chars"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"),
    "upper": ("n_upper", "word_chars"),
}
#: Strata up to which the table of cutoffs is broadcast; beyond, the join shuffles.
BROADCAST_STRATA = 10_000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(w: Column) -> Column:
    """Words covered by five-word windows that occur twice or more, in O(n log n)."""
    hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 5), lambda i: F.xxhash64(*(w[i + k] for k in range(5))))

    def covered(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            twin = F.filter(s, lambda x, k: ((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)))
            return F.sort_array(F.transform(twin, lambda x: x["i"]))

        gaps = let(let(pairs, places), lambda p: F.transform(p, lambda x, k: F.coalesce(F.least(F.get(p, k + 1) - x, F.lit(5)), F.lit(5))))
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    repeated = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))
    return F.when(F.size(w) < 5, F.lit(0)).otherwise(repeated)


def measures(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Append the counts that the rules read. Null texts count as empty."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    words = let(F.regexp_extract_all(t, F.lit(f"({WORD})"), F.lit(1)), lambda w: F.struct(F.size(w).alias("n"), _repeat_words(w).alias("r")))
    lines = let(F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD)), lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("d")))
    return (
        df.withColumns({"_w": words, "_l": lines})
        .withColumns({
            "n_words": F.col("_w.n").cast("long"),
            "word_chars": F.length(F.translate(t, " \t\n\u000b\f\r", "")).cast("long"),
            "n_symbols": (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long"),
            "n_dup_lines": F.col("_l.d").cast("long"),
            "n_repeat_words": F.col("_w.r").cast("long"),
            "n_lines": F.col("_l.n").cast("long"),
            "n_upper": F.length(F.regexp_replace(t, r"\P{Lu}+", "")).cast("long"),
        })
        .withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
        .drop("_w", "_l")
    )


def _log_gamma(x: Column) -> Column:
    """Stirling's series, after a step up by 10; relative error below 1e-13 for x >= 1."""
    z = x + 10.0
    series = (z - 0.5) * F.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5)
    down = F.lit(0.0)
    for i in range(10):
        down = down + F.log(x + float(i))
    return series - down


def log_tail(k: Column, n: Column, p: float) -> Column:
    """Log of P(Binomial(n, p) <= k) for k <= n p: the term at k, and its ratios to those below.

    Terms further below than 20 standard deviations cannot change a double, so that the
    sum stays short however large n is.
    """
    n, k = n.cast("double"), k.cast("double")
    at_k = _log_gamma(n + 1) - _log_gamma(k + 1) - _log_gamma(n - k + 1) + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p))
    steps = F.least(k, F.ceil(20 * F.sqrt(n * p)) + 100).cast("int")
    acc = F.aggregate(
        F.sequence(F.lit(0), steps),
        F.struct(F.lit(1.0).alias("t"), F.lit(0.0).alias("s")),
        lambda a, i: F.struct((a["t"] * (k - i) * (1 - p) / ((n - k + i + 1) * p)).alias("t"), (a["s"] + a["t"]).alias("s")),
    )
    return at_k + F.log(acc["s"])


def _ratio(rule: str) -> Column:
    top, bottom = RULES[rule]
    return F.when(F.col(bottom) > 0, F.col(top) / F.col(bottom)).otherwise(0.0)


def calibrate(measured: DataFrame, good: DataFrame, stratum: str = "stratum", risk: float = RISK, error: float = ERROR) -> DataFrame:
    """Cutoffs per stratum: one column per rule, null where none is proven safe.

    ``good`` holds the ids of documents labelled good; all of them take part. Counts come
    from one aggregate, with a row per stratum; a stratum without a proven cutoff has no row.
    """
    per_rule = risk / len(RULES)
    held = measured.join(good.select("doc_id").distinct(), "doc_id", "left_semi")
    counts = [
        F.struct(F.lit(r).alias("rule"), F.lit(c).alias("c"), F.sum((_ratio(r) > c).cast("long")).alias("k")) for r in RULES for c in CUTOFFS
    ]
    per = materialize(held.groupBy(stratum).agg(F.count("*").alias("n"), F.array(*counts).alias("seen")), "counts")
    tests = per.count() * len(counts)
    # a row per test, so that the tail is one expression
    tried = per.select(stratum, "n", F.inline("seen")).where(F.col("k") < F.col("n") * per_rule)
    safe = tried.where(log_tail(F.col("k"), F.col("n"), per_rule) <= math.log(error / max(1, tests)))
    return safe.groupBy(stratum).agg(*(F.min(F.when(F.col("rule") == r, F.col("c"))).alias(f"cut_{r}") for r in RULES))


def judge(measured: DataFrame, cutoffs: DataFrame, stratum: str = "stratum") -> DataFrame:
    """Append ``kept``: false if a base rule or a proven cutoff rejects the text."""
    small = cutoffs.limit(BROADCAST_STRATA + 1).count() <= BROADCAST_STRATA
    out = measured.join(F.broadcast(cutoffs) if small else cutoffs, stratum, "left")
    fails = F.lit(False)
    for r in RULES:
        fails = fails | F.coalesce(_ratio(r) > F.col(f"cut_{r}"), F.lit(False))
    return out.withColumn("kept", ~(F.col("base_failed") | fails)).drop(*(f"cut_{r}" for r in RULES))


def apply_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Measures, base rules and verdict per document of ``docs`` (doc_id, text, lang).

    Null languages form a stratum of their own; null and empty texts fail the base rules;
    repeated rows are judged alike; of a document's labels the highest counts. Texts of any
    length are read whole; other columns are not read; an empty table gives an empty table.
    """
    m = measures(docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("stratum"), "text")).drop("text")
    m = materialize(m, "rules")  # read by the calibration and by the verdict
    good = labels.groupBy("doc_id").agg(F.max("quality").alias("q")).where("q = 1 and doc_id is not null")
    cut = materialize(calibrate(m, good), "cutoffs")
    return judge(m, cut)


def _oracle() -> str:
    measures_sql = r"""
d AS (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
k AS (SELECT row_number() OVER () AS rid, * FROM w),
win AS (SELECT rid, i, array_to_string(w[i:i+4], ' ') AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM k)),
twin AS (SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
rep AS (SELECT rid, sum(least(5, coalesce(nxt - i, 5)))::BIGINT AS r FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM twin) GROUP BY rid),
m AS (SELECT doc_id, stratum, len(w)::BIGINT AS n_words,
        length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
        coalesce(r, 0)::BIGINT AS n_repeat_words, len(l)::BIGINT AS n_lines,
        length(regexp_replace(t, '[^\p{Lu}]', '', 'g'))::BIGINT AS n_upper
      FROM k LEFT JOIN rep USING (rid)),
b AS (SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed, """
    measures_sql += ", ".join(f"CASE WHEN {b} > 0 THEN {a}::DOUBLE / {b} ELSE 0.0 END AS x_{r}" for r, (a, b) in RULES.items())
    measures_sql += " FROM m),"
    grid = ", ".join(f"({c})" for c in CUTOFFS)
    long = " UNION ALL ".join(f"SELECT stratum, '{r}' AS rule, x_{r} AS x FROM held" for r in RULES)
    p = RISK / len(RULES)
    tests = len(RULES) * len(CUTOFFS)
    cut = f"""
good AS (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id HAVING max(quality) = 1),
held AS (SELECT * FROM b WHERE doc_id IN (SELECT doc_id FROM good)),
seen AS (SELECT stratum, rule, c, count(*)::DOUBLE AS n, sum((x > c)::INT)::DOUBLE AS k
         FROM ({long}) CROSS JOIN (VALUES {grid}) AS g(c) GROUP BY ALL),
safe AS (SELECT stratum, rule, min(c) AS cut FROM seen WHERE k < n * {p} AND
           ln(list_sum(list_transform(range(0, k::BIGINT + 1), lambda j: exp(
             lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({p}) + (n - j) * ln({1 - p})))))
           <= ln({ERROR} / ((SELECT count(DISTINCT stratum) FROM held) * {tests})) GROUP BY ALL)"""
    fails = " OR ".join(f"coalesce(x_{r} > (SELECT cut FROM safe s WHERE s.stratum = b.stratum AND s.rule = '{r}'), false)" for r in RULES)
    return (
        f"WITH {measures_sql}{cut} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, "
        f"base_failed, NOT (base_failed OR {fails}) AS kept FROM b"
    )


ORACLE = _oracle()
