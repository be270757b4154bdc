"""Rabin fingerprints of byte strings, as polynomials over GF(2).

Bit 63 of a value stands for x^0 and bit 0 for x^63, so that a shift right multiplies by
x. A string's fingerprint is the remainder of x^(64+8n) plus the string, read as a
polynomial, by an irreducible one. The table holds, for each byte that a shift by eight
pushes out at x^63, what comes back in.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The polynomials of the URL key, the 64-bit bucket key and the workset hash.
POLY64, DEGREE64 = 0xD74307D3FD3382DB, 64
POLY31, DEGREE31 = 0xBA75BB4300000000, 31
POLY32, DEGREE32 = 0x9B6C9A2F80000000, 32
WORKSET_BITS = 8
MASK = (1 << 64) - 1


def powers(poly: int, degree: int, n: int = 128) -> list[int]:
    """x^0 .. x^(n-1), each modulo the polynomial."""
    out, v = [], 1 << 63
    for _ in range(n):
        out.append(v)
        v = v >> 1 ^ (poly if v >> (64 - degree) & 1 else 0)
    return out


def _combine(pw: list[int], top: int) -> list[int]:
    """For each byte whose bit k stands for x^(top-k): its remainder."""
    table = [0] * 256
    for j in range(256):
        for k in range(8):
            if j >> k & 1:
                table[j] ^= pw[top - k]
    return table


def tables(poly: int, degree: int) -> tuple[int, list[int], list[list[int]]]:
    """Value of the empty string, the byte table, and the tables of the final reduction."""
    pw = powers(poly, degree)
    low_bytes = 0 if degree == 64 else 8 - degree // 8
    return pw[64], _combine(pw, 71), [_combine(pw, 63 - 8 * i) for i in range(low_bytes)]


def fingerprint_bytes(data: bytes, poly: int = POLY64, degree: int = DEGREE64, seed: int | None = None) -> int:
    """Unsigned fingerprint of one string; ``seed`` extends a former value."""
    empty, step, low = tables(poly, degree)
    f = empty if seed is None else seed
    for b in data:
        f = f >> 8 ^ step[(f ^ b) & 255]
    return _reduce(f, low)


def _reduce(f: int, low: list[list[int]]) -> int:
    if not low:
        return f
    out = f >> 8 * len(low) << 8 * len(low)
    for i, t in enumerate(low):
        out ^= t[f >> 8 * i & 255]
    return out


def signed(v: int) -> int:
    return v - (1 << 64) if v >> 63 else v


def fingerprint_column(values: list[bytes], poly: int, degree: int, seeds: np.ndarray | None = None) -> np.ndarray:
    """Signed fingerprints of many strings, one vector step per byte place; ``seeds`` are
    former values to extend."""
    empty, step, low = tables(poly, degree)
    step = np.array(step, np.uint64)
    size = np.array([len(v) for v in values], np.int64)
    order = np.argsort(-size, kind="stable")
    f = np.full(len(values), empty, np.uint64) if seeds is None else seeds.view(np.uint64)[order]
    flat = np.frombuffer(b"".join(values[i] for i in order), np.uint8)
    size = size[order]
    first = np.cumsum(size) - size
    for at in range(int(size[0]) if len(size) else 0):
        n = int(np.searchsorted(-size, -at, "left"))
        g = f[:n]
        f[:n] = g >> np.uint64(8) ^ step[((g ^ flat[first[:n] + at]) & np.uint64(255)).astype(np.int64)]
    if low:
        out = f >> np.uint64(8 * len(low)) << np.uint64(8 * len(low))
        for i, t in enumerate(low):
            out ^= np.array(t, np.uint64)[(f >> np.uint64(8 * i) & np.uint64(255)).astype(np.int64)]
        f = out
    back = np.empty_like(f)
    back[order] = f
    return back.view(np.int64)


def _udf(poly: int, degree: int, charwise: bool):
    def run(s):
        import pandas as pd

        # the older variant takes each character as two bytes, the low one last in value order
        values = [b"" if x is None else x.encode("utf-16-le") if charwise else x.encode() for x in s]
        out = pd.Series(fingerprint_column(values, poly, degree), dtype="Int64")
        out[s.isna().to_numpy()] = pd.NA
        return out

    return F.pandas_udf(run, "long")


def frontier_id(url: Column | str) -> Column:
    """The 64-bit signed key of a URL; null for null."""
    return _udf(POLY64, DEGREE64, False)(url)


def fingerprint_charwise(text: Column | str) -> Column:
    """The older 16-bit-per-character variant, for legacy buckets."""
    return _udf(POLY64, DEGREE64, True)(text)


def fingerprint_32(text: Column | str) -> Column:
    """Degree-32 fingerprint, left-aligned in 64 bits."""
    return _udf(POLY32, DEGREE32, False)(text)


def extend(value: Column, text: Column) -> Column:
    """The 64-bit fingerprint of a string and ``text`` after it, from the ``value`` of the
    string; null where either is null."""
    @F.pandas_udf("long")
    def run(f, s):
        import pandas as pd

        return pd.Series(fingerprint_column([x.encode() for x in s], POLY64, DEGREE64, f.to_numpy()))

    return F.when(value.isNotNull() & text.isNotNull(), run(F.coalesce(value, F.lit(0).cast("long")), F.coalesce(text, F.lit(""))))


def host_hash(prefix: Column | str) -> Column:
    """Degree-31 hash of a domain prefix, left-aligned in 64 bits."""
    return _udf(POLY31, DEGREE31, False)(prefix)


def workset(prefix: Column | str, bits: int = WORKSET_BITS) -> Column:
    """The top bits of the host hash."""
    return F.shiftrightunsigned(host_hash(prefix), 64 - bits).cast("int")


def duck_tables() -> str:
    """CTE body with the tables, for SQL that has no such function."""
    def lit(t):
        return "[" + ", ".join(f"{v}::UBIGINT" for v in t) + "]"

    e64, t64, _ = tables(POLY64, DEGREE64)
    e31, t31, low = tables(POLY31, DEGREE31)
    cols = [f"{e64}::UBIGINT AS e64", f"{lit(t64)} AS t64", f"{e31}::UBIGINT AS e31", f"{lit(t31)} AS t31"]
    cols += [f"{lit(t)} AS r{i}" for i, t in enumerate(low)]
    return "tb AS (SELECT " + ", ".join(cols) + ")"


def _duck_raw(expr: str, kind: str, charwise: bool = False) -> str:
    byte = f"('0x' || substr(hex(encode({expr})), (2 * i - 1)::INT, 2))::UBIGINT"
    items = f"list_transform(range(1, octet_length(encode({expr})) + 1), lambda i: {f'[{byte}, 0::UBIGINT]' if charwise else byte})"
    return (
        f"list_reduce(list_prepend(e{kind}, {f'flatten({items})' if charwise else items}), "
        f"lambda f, v: xor(f >> 8, t{kind}[(xor(f, v) & 255)::BIGINT + 1]))"
    )


def duck_unsigned(expr: str, charwise: bool = False) -> str:
    """DuckDB expression of the unsigned 64-bit fingerprint (charwise: of ASCII text)."""
    return _duck_raw(expr, "64", charwise)


def duck_id(expr: str, charwise: bool = False) -> str:
    """DuckDB expression of :func:`frontier_id`; ``tb`` must be in scope."""
    raw = _duck_raw(expr, "64", charwise)
    return f"(CASE WHEN {raw} >= 9223372036854775808::UBIGINT THEN ({raw}::HUGEINT - 18446744073709551616::HUGEINT)::BIGINT ELSE {raw}::BIGINT END)"


def duck_workset(expr: str) -> str:
    raw = _duck_raw(expr, "31")
    # the top byte is in the part that the reduction keeps, and in what it folds in
    folded = f"list_reduce([(g >> 40) << 40, " + ", ".join(f"r{i}[((g >> {8 * i}) & 255)::BIGINT + 1]" for i in range(5)) + "], lambda a, b: xor(a, b))"
    return f"((list_transform([{raw}], lambda g: {folded}))[1] >> 56)::INT"
