from collections import Counter

import numpy as np
import pytest
from test_learned import SF

from spindrift.llm import bagminhash as bmh
from spindrift.llm import queries


def bag(text):
    w = text.split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def jaccard(a, b):
    low = sum((a & b).values())
    return low / (sum(a.values()) + sum(b.values()) - low) if a and b else 0.0


def brute(rows):
    """Union-find over every pair of documents that share a shingle."""
    rows = [(d, t or "") for d, t in rows if d is not None]
    bags = [bag(t) for _, t in rows]
    top = {d: d for d, _ in rows}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    where = {}
    for i, b in enumerate(bags):
        for s in b:
            where.setdefault(s, []).append(i)
    done = set()
    for group in where.values():
        for n, i in enumerate(group):
            for j in group[:n]:
                if (i, j) not in done:
                    done.add((i, j))
                    if jaccard(bags[i], bags[j]) >= 0.8:
                        a, b = find(rows[i][0]), find(rows[j][0])
                        top[max(a, b)] = min(a, b)
    return sorted((d, find(d)) for d, _ in rows)


def test_signature_is_unbiased():
    rng = np.random.default_rng(2)
    m = 4096
    for hi in (2, 40):
        wa, wb = rng.integers(0, hi, 60), rng.integers(0, hi, 60)
        wb[:40] = wa[:40]
        x = rng.integers(1, 2**63, 60).astype(np.uint64)
        doc = np.repeat([0, 1], 60)
        w, xs = np.r_[wa, wb], np.r_[x, x]
        keep = w > 0
        s = bmh.signatures(doc[keep], xs[keep], w[keep], 2, m)
        want = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
        assert abs((s[0] == s[1]).mean() - want) < 4 * (want * (1 - want) / m) ** 0.5


def test_op3_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(tuple(r) for r in queries.op3_near_duplicates(spark, SF).collect())
    assert got == brute([tuple(r) for r in docs])
    assert len({c for _, c in got}) < len(got)


def test_odd_rows_and_chains(spark):
    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in rng.integers(0, 300, 200)]
    rows = [(i, None) for i in (1, 2)] + [(3, ""), (4, " \n"), (5, "one"), (6, "one"), (7, "one two"), (8, "x " * 9000), (9, "x " * 9000), (None, "one")]
    rows += [(5, "one"), (6, "other words altogether here now")]
    chain = list(base)
    for n in range(25):  # neighbours in the chain are near, its ends are not
        rows.append((100 + n, " ".join(chain)))
        for k in rng.integers(0, 200, 3):
            chain[k] = f"n{n}{k}"
    for n in range(40):  # a crowd around the same text
        c = list(base)
        for k in rng.integers(0, 200, 4):
            c[k] = f"c{n}{k}"
        rows.append((300 + n, " ".join(c)))
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, content string")
    out = bmh.classes(df).collect()
    assert len(out) == len(rows) and [r.class_id for r in out if r.doc_id is None] == [None]
    assert sorted({tuple(r) for r in out if r.doc_id is not None}) == sorted(set(brute(rows)))
    assert bmh.classes(df.limit(0)).count() == 0


def test_two_node_bucket_of_a_passed_over_leader(spark):
    """2 and 3 are near and share buckets of two only; 1, near to none, has more buckets of 3 and the lesser id."""
    x = [f"2094x{i}" for i in range(204)]
    a, c = [f"2094a{i}" for i in range(23)] + x[23:], x[:-22] + [f"2094c{i}" for i in range(22)]
    rows = [(1, " ".join(a)), (2, " ".join(c)), (3, " ".join(x))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bands = {r.doc_id: set(r.bands) for r in bmh.sign(df).collect()}
    assert len(bands[1] & bands[3]) > len(bands[2] & bands[3]) > 0 and not bands[1] & bands[2] & bands[3]
    assert sorted(tuple(r) for r in bmh.classes(df).collect()) == brute(rows) == [(1, 1), (2, 2), (3, 2)]


@pytest.mark.parametrize("block,linear,hot,together", [(4, 0, 2, 10), (8, 2, 3, 100)])
def test_blocks_of_crowded_buckets(spark, monkeypatch, block, linear, hot, together):
    """Families of texts at 0.6 to 0.9, in small blocks: by pairs, by whole blocks, and by salted leaders."""
    monkeypatch.setattr(bmh, "BLOCK", block)
    monkeypatch.setattr(bmh, "LINEAR", linear)
    monkeypatch.setattr(bmh, "HOT", hot)
    monkeypatch.setattr(bmh, "TOGETHER", together)
    rng = np.random.default_rng(block)
    rows = []
    for family in range(4):
        base = [f"f{family}w{i}" for i in range(120)]
        for n in range(22):
            c = list(base)
            for k in rng.integers(0, 120, int(rng.integers(1, 12))):
                c[k] = f"f{family}c{n}k{k}"
            rows.append((int(family * 100 + n), " ".join(c)))
    for n in range(400):  # pairs at 0.8 to 0.9
        x = [f"p{n}w{i}" for i in range(104)]
        rows += [(1000 + 2 * n, " ".join(x)), (1001 + 2 * n, " ".join([*x[:50], f"p{n}y", *x[51:], *(f"p{n}t{i}" for i in range(n % 14))]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in bmh.classes(df).collect())
    want = brute(rows)
    near = [g == w for g, w in zip(got, want) if w[0] != w[1]]
    assert 300 < len(near) and sum(near) >= 0.99 * len(near)  # recall
    assert [g for g, w in zip(got, want) if w[0] < 1000] == [w for w in want if w[0] < 1000]
    assert all(g == w for g, w in zip(got, want) if w[0] == w[1])
