import hashlib

import numpy as np
from test_learned import SF

from spindrift.llm import queries, suffix_dedup as sd


def brute(rows):
    """First place of every 100-byte string, then the bytes that later places cover."""
    first = {}
    texts = [(d, (t or "").encode()) for d, t in rows]
    for d, t in texts:
        if d is not None:
            for i in range(len(t) - 99):
                k = t[i : i + 100]
                if k not in first or (d, i) < first[k]:
                    first[k] = (d, i)
    out = []
    for d, t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - 99 if d is not None else 0):
            if first[t[i : i + 100]] != (d, i):
                gone[i : i + 100] = True
        gone = gone[:-1]
        spans = int((np.diff(np.r_[0, gone.astype(np.int8)]) == 1).sum())
        out.append((d, len(t), int(gone.sum()), spans, bytes(np.frombuffer(t, np.uint8)[~gone])))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in sd.dedup(df).collect()), key=repr)


def test_op1_equals_brute_force(spark):
    """The registered query on the whole table."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    out = queries.op1_suffix_dedup(spark, SF)
    assert out.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    want = sorted((d, n, gone, spans, hashlib.sha256(kept).hexdigest()) for d, n, gone, spans, kept in brute(rows))
    assert sorted(tuple(r) for r in out.collect()) == want and sum(w[2] > 0 for w in want) > 100


def test_odd_texts(spark):
    rng = np.random.default_rng(7)
    words = [f"{a}{b}" for a in "abcdé" for b in "xyz"]
    base = " ".join(rng.choice(words, 400))
    rows = [(1, None), (2, ""), (3, "a" * 99), (4, "a" * 100), (5, "a" * 1000), (6, base), (7, base), (7, base), (None, base), (8, base[50:] + "Z" + base[:300])]
    rows += [(8, "other " + base[100:260]), (9, "\0" * 150), (10, base[:120] + base[:120]), (12, base[10:111])]
    line = " ".join(rng.choice(words, 12))
    for n in range(60):
        mine = " ".join(rng.choice(words, 60))
        edits = list(base)
        for k in rng.integers(0, len(edits), 5):
            edits[k] = "#"
        rows.append((20 + n, (mine[: n * 3] + line + mine[n * 3 :]) if n % 2 else "".join(edits)))
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, tag int").repartition(5)
    assert got(df) == brute(rows)
    assert sd.dedup(df.limit(0)).count() == 0


def test_many_parts_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(11)
    base = "".join(rng.choice(list("abcdef "), 600))
    rows = [(1, base)]
    for n in range(30):
        edits = list(base)
        for k in rng.integers(0, len(edits), 3):
            edits[k] = "#"
        rows.append((2 + n, "".join(edits)))
    monkeypatch.setattr(sd, "parts", lambda spark: 64)
    assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == brute(rows)


def test_long_text_slices(spark, monkeypatch):
    rng = np.random.default_rng(8)
    base = "".join(rng.choice(list("abc "), 700))
    monkeypatch.setattr(sd, "_SLICE", 500)
    texts = [(base + "x" + base[100:400] + base).encode(), base[3:].encode()]
    seen = set()
    for i, at, buf, first, size in sd._buffers(texts):
        doc, place, _, lo, hi = sd.anchors(buf, first, size)
        for d, a, x, y in zip(doc, lo - first[doc] + at, lo, hi):
            seen.update((i + d, a + k) for k in range(y - x + 1))
    assert seen == {(i, k) for i, t in enumerate(texts) for k in range(len(t) - 99)}


def test_long_text_behind_a_short_one(monkeypatch):
    texts = [b"short", b"z" * (2**24 + 500), b"end" * 50]
    assert max(len(buf) for _, _, buf, _, _ in sd._buffers(texts)) < 2**24
    rng = np.random.default_rng(12)
    base = "".join(rng.choice(list("abc "), 700)).encode()
    monkeypatch.setattr(sd, "_SLICE", 500)
    texts = [base[:130], base + b"x" + base, base[5:200], base[:450], base * 2, b""]
    seen = set()
    for i, at, buf, first, size in sd._buffers(texts):
        assert len(buf) <= 3 * 500
        doc, place, _, lo, hi = sd.anchors(buf, first, size)
        for d, a, x, y in zip(doc, lo - first[doc] + at, lo, hi):
            seen.update((i + d, a + k) for k in range(y - x + 1))
    assert seen == {(i, k) for i, t in enumerate(texts) for k in range(len(t) - 99)}


def test_loser_tree_merges_and_measures():
    rng = np.random.default_rng(9)
    runs, every = [], []
    for n in (40, 0, 1, 73, 5):
        rows = np.zeros((n, 100), np.uint8)
        size = rng.integers(84, 101, n)
        for i in range(n):
            rows[i, : size[i]] = rng.integers(97, 99, size[i])
            rows[i, : rng.integers(0, 100)] = 97
            rows[i, size[i] :] = 0
        order = sd._order(rows, size)
        rows, size = rows[order], size[order]
        every += [bytes(r[:k]) for r, k in zip(rows, size)]
        runs.append(sd.Run(sd.Run.pack(rows, size, np.zeros(n, sd._PAYLOAD))))
    flat = [[bytes(x) for x in _decode(r)] for r in runs]
    for r in runs:
        r.i, r.at, r.now = -1, 0, b""
    run, row, shared = sd.merge(runs)
    out = [flat[a][b] for a, b in zip(run, row)]
    assert out == sorted(every)
    for k in range(1, len(out)):
        a, b = out[k - 1], out[k]
        n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert shared[k] == n


def _decode(run):
    while run.step() >= 0:
        yield run.now
