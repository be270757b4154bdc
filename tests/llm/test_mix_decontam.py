import numpy as np
import pandas as pd
from test_learned import SF, same

from spindrift.llm import decontam, mixing, queries


def test_op2_equals_sql(spark):
    same(queries.op2_mixing(spark, SF), mixing.ORACLE)


def test_mix_odd_rows(spark):
    rows = [(i % 40, "w " * (i % 7), ["en", "fr", None, "xx"][i % 4], ["src0", "src1", "junk", None, "src0"][i % 5]) for i in range(90)]
    rows += [(None, "a b", "en", "src0"), (1, None, "en", "src2"), (500, "x " * 100_000, "de", "src5")]
    docs = pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source"]).astype({"doc_id": "Int64"})
    df = spark.createDataFrame([(*r, "extra") for r in rows], "doc_id long, text string, lang string, source string, q string")
    cols = ["doc_id", "domain", "lang", "source", "n_tokens", "epoch"]
    same(mixing.mix(df).select(cols), mixing.ORACLE, documents=docs)
    assert mixing.mix(df.limit(0)).count() == 0


def test_shortage_goes_to_siblings_first(spark):
    leaves = spark.createDataFrame(
        [("a", "x", "1", 10), ("a", "x", "2", 1000), ("a", "y", "3", 1000), ("b", "x", "4", 20)], "domain string, lang string, source string, tokens long")
    got = {r.source: r.share for r in mixing.allocate(leaves, 200, {}, 1).collect()}
    # b can give 20 of its 100: a gets 180, halves of 90; source 1 gives 10, its sibling the other 80
    assert got == {"1": 10, "2": 80, "3": 90, "4": 20}
    # no token is lost to rounding, and the largest remainders get what is left
    got = {r.source: r.share for r in mixing.allocate(leaves, 174, {"lang": {"y": 2}}, 1).collect()}
    assert got == {"1": 10, "2": 41, "3": 103, "4": 20}


def brute(docs, items):
    """Every diagonal of every pair, without seeds."""
    out = {}
    for d, text in docs:
        dw = decontam.words_of(text or "")
        for k, item in items:
            iw = decontam.words_of(item or "")
            for at in range(-len(iw) + 1, len(dw)):
                q, n = max(0, -at), 0
                n = min(len(iw) - q, len(dw) - at - q)
                if n <= 0:
                    continue
                s, e, m = decontam.best_segment(np.array([a == b for a, b in zip(iw[q:], dw[at + q : at + q + n])]))
                if m >= min(13, len(iw)) and m >= 0.75 * (e - s):
                    out[d, k] = max(out.get((d, k), 0), m)
    return out


def test_op8_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    items = [(r.item_id, r.text) for r in bench[:8]] + [(900, "five short words stand here"), (901, None), (902, "")]
    docs = [(1, None), (2, ""), (3, "see: five short words stand here now"), (7, "plain text " * 40)]
    filler = [f"w{i}" for i in range(500)]
    for n in range(30):
        w = items[n % 8][1].split()
        if n % 3:
            lo = int(rng.integers(0, len(w) // 3))
            w = w[lo:]
        for _ in range(n % 4):
            w[int(rng.integers(len(w)))] = "swapped"
        docs.append((100 + n, " ".join([*rng.choice(filler, 30), *w, *rng.choice(filler, 30)])))
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, item_id int")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    for size in (10**6, 300):
        got = {(r.doc_id, r.item_id): r.matched for r in decontam.contamination(df, b, size).collect()}
        missed = want.keys() - got.keys()
        assert got.keys() <= want.keys() and len(missed) <= 1, missed
        assert sum(got[k] == want[k] for k in got) >= len(got) - 1
    assert {(3, 900)} <= got.keys() and not {k for k in got if k[0] in (1, 2, 7)}
    assert decontam.contamination(df.limit(0), b).count() == 0
    assert decontam.contamination(df, b.limit(0)).count() == 0


def test_op8_short_items_with_a_quarter_changed(spark):
    rng = np.random.default_rng(6)
    items, docs = [], []
    for n in range(9, 18):
        for k in range(6):
            key = 10 * n + k
            w = [f"i{key}w{j}" for j in range(n)]
            items.append((key, " ".join(w)))
            for d, changed in ((key, n // 4), (1000 + key, n // 4 + 1)):
                for j in rng.choice(n, changed, replace=False):
                    w[j] = "changed"
                docs.append((d, " ".join(["before", *w, "after"])))
                w = [f"i{key}w{j}" for j in range(n)]
    df, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.matched) for r in decontam.contamination(df, b).collect()}
    assert got == {(key, key, len(t.split()) - len(t.split()) // 4) for key, t in items}


def test_op8_copies_of_items_and_rows_without_id(spark):
    text = " ".join(f"i{n}" for n in range(30))
    b = spark.createDataFrame([(1, text), (2, text), (2, text), (3, "a " * 400), (None, "n " * 30)], "item_id long, text string")
    rows = [(None, "x " + text), (7, text + " y"), (7, "clean words only"), (8, "a " * 3000), (9, "n " * 50)]
    df = spark.createDataFrame([(*r, "own") for r in rows], "doc_id long, text string, item string")
    for size in (10**6, 100):
        got = sorted((r.doc_id or 0, r.item_id) for r in decontam.contamination(df, b, size).collect())
        assert got == [(0, 1), (0, 2), (0, 2), (7, 1), (7, 2), (7, 2), (8, 3)]
        assert sorted(tuple(r) for r in decontam.clean(df, b, size).collect()) == [(7, "clean words only", "own"), (9, "n " * 50, "own")]
        assert decontam.clean(df, b, size).columns == df.columns


def test_op8_meetings_are_taken_in_steps(monkeypatch):
    index = decontam.Index([(1, "a b " * 60), (2, "a " * 50 + "c d e f g h i j k l m n o"), (3, "q r s " * 9)])
    texts = ["a b " * 300, "x " * 30 + "a " * 200, "q r s " * 20 + "a", ""]
    whole = decontam.overlaps(index, texts)
    monkeypatch.setattr(decontam, "STEP", 7)
    assert decontam.overlaps(index, texts) == whole and [[r[0] for r in rows] for rows in whole] == [[1], [2], [3], []]


def test_op8_finds_whole_items(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    got = {(r.doc_id, r.item_id) for r in queries.op8_decontamination(spark, SF).collect()}
    whole = {(d.doc_id, i.item_id) for d in docs for i in items if i.text in d.text}
    assert whole <= got
    print(len(whole), len(got))
