"""Public-suffix rules: a table of reversed labels and kinds, from the published text form.

The full list is read from Spark's own class path, where its HTTP client keeps a copy. The
families below, which the list of today words otherwise, are added to it. A table may be
given to whatever reduces a domain: pin one (``parse_rules`` of a file) where worksets must
stay the same over upgrades of Spark.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

LIST = "mozilla/public-suffix-list.txt"
#: Common rules of about 2012, in the text form of the public suffix list.
RULES_TEXT = """
// generic
com
net
org
edu
gov
info
biz
// second levels
co.nz
ac.nz
com.au
net.au
org.au
edu.au
gov.au
co.jp
ac.jp
ne.jp
or.jp
go.jp
com.br
org.br
gov.br
com.cn
net.cn
org.cn
co.in
co.kr
or.kr
co.za
org.za
com.mx
com.ar
com.tr
com.tw
// wildcards and exceptions
*.uk
!bl.uk
!british-library.uk
!parliament.uk
!nhs.uk
!police.uk
*.tokyo.jp
!metro.tokyo.jp
*.kawasaki.jp
!city.kawasaki.jp
*.ck
!www.ck
*.er
*.fk
"""


def parse_rules(text: str) -> list[tuple[str, str]]:
    """Rows (reversed labels joined by commas, kind) of a rule file: ``//`` starts a
    comment, ``*.`` a wildcard, ``!`` an exception; blank lines and case do not matter."""
    out = []
    for line in text.splitlines():
        rule = line.split("//")[0].strip().lower()
        if not rule:
            continue
        kind = "normal"
        if rule.startswith("!"):
            kind, rule = "exception", rule[1:]
        elif rule.startswith("*."):
            kind, rule = "wildcard", rule[2:]
        out.append((",".join(reversed(rule.split("."))), kind))
    return sorted(set(out))


RULES = parse_rules(RULES_TEXT)


def of_kind(kind: str, rules: list[tuple[str, str]] = RULES) -> list[str]:
    return [r for r, k in rules if k == kind]


@lru_cache
def known_rules() -> list[tuple[str, str]]:
    """The fixed rules, and the registry part of the list on the active session's class path."""
    jvm = SparkSession.active().sparkContext._jvm
    stream = jvm.Thread.currentThread().getContextClassLoader().getResourceAsStream(LIST)
    if stream is None:
        return RULES
    text = bytes(stream.readAllBytes()).decode("utf-8")
    stream.close()
    text = text.split("===BEGIN ICANN DOMAINS===")[-1].split("// ===END ICANN DOMAINS===")[0]
    # one label alone is the default rule already
    return sorted({*RULES, *((r, k) for r, k in parse_rules(text) if "," in r or k != "normal")})


def _among(value: Column, names: list[str]) -> Column:
    """``value.isin(names)``, whose names go to the JVM in one call."""
    jvm = SparkSession.active().sparkContext._jvm
    parts = jvm.java.util.Collections.list(jvm.java.util.StringTokenizer(" ".join(names)))
    return type(value)(value._jc.isin(jvm.PythonUtils.toSeq(parts)))


def registered(labels: Column, rules: list[tuple[str, str]] | None = None) -> Column:
    """Reversed labels of a host, cut to its registered domain, with a comma after each.

    The suffix has k labels, 1 to 5, and one less than the host at most: the most for which
    k is 1, the first k labels are a rule, or the first k - 1 labels are a wildcard; if the
    first k + 1 labels are an exception, this k holds.
    """
    rules = known_rules() if rules is None else rules
    most = 5

    def known(kind: str, r: Column, k: int) -> Column:
        """The first k labels are a rule of this kind: only rules of k labels are asked."""
        names = [x for x in of_kind(kind, rules) if x.count(",") + 1 == k]
        return _among(F.lower(F.array_join(F.slice(r, 1, k), ",")), names) if names else F.lit(False)

    def cut(r: Column) -> Column:
        suffix = F.when(F.lit(False), 0)
        for k in range(1, most + 1):
            suffix = suffix.when((F.size(r) > k) & known("exception", r, k + 1), k)
        for k in range(most, 1, -1):
            suffix = suffix.when((F.size(r) > k) & (known("normal", r, k) | known("wildcard", r, k - 1)), k)
        return F.concat(F.array_join(F.slice(r, F.lit(1), suffix.otherwise(1) + 1), ","), F.lit(","))

    return F.transform(F.array(labels), cut)[0]


def rule_pattern(rules: list[tuple[str, str]] = RULES) -> str:
    """The rules as one regular expression over reversed hosts (a comma after each label):
    its match is the registered domain. The longest rule stands first, exceptions before."""
    def label(x: str) -> str:
        return "".join(c if c.isalnum() or c in "-," else f"\\{c}" for c in x)

    free = r"[-\w]+,"
    parts = [f"{label(r)}," for r in sorted(of_kind("exception", rules), key=lambda r: -r.count(","))]
    normal = [(r.count(",") + 1, f"{label(r)},{free}") for r in of_kind("normal", rules)]
    wild = [(r.count(",") + 2, f"{label(r)},{free}{free}") for r in of_kind("wildcard", rules)]
    parts += [p for _, p in sorted(normal + wild, key=lambda x: (-x[0], x[1]))]
    return "(?i)^(?:" + "|".join([*parts, free + free]) + ")"
