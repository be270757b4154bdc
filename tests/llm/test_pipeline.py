import os

import public_tokenizers
from pyspark.sql import functions as F
from test_bagminhash import brute as near_brute
from test_learned import SF
from test_tokens import expected

import corpus_pipeline as cp
from spindrift.llm import decontam, gbdt, mixing


def test_stages_against_plain_versions(spark):
    import duckdb

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    trees = gbdt.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = docs.collect()
    import numpy as np

    s = trees.score(np.array([gbdt.statistics(r.text) for r in rows]))
    rows = [r for r, x in zip(rows, s) if x >= 0.5]
    class_of = dict(near_brute([(r.doc_id, r.text) for r in rows]))
    rows = [r for r in rows if class_of[r.doc_id] == r.doc_id]
    df = spark.createDataFrame(rows, docs.schema)
    leaked = {r.doc_id for r in decontam.contamination(df, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    rows = [r for r in rows if r.doc_id not in leaked]
    con = duckdb.connect()
    con.register("documents", spark.createDataFrame(rows, docs.schema).toPandas())
    text = {r.doc_id: r.text for r in rows}
    taken = [(d, text[d]) for (d, *_) in con.execute(mixing.ORACLE).fetchall()]
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    got = sorted(tuple(r) for r in cp.run(spark, SF).collect())
    assert [x.split("-")[:2] for x in set(os.listdir(folder)) - before] == [["stage", "tokens"]]  # nothing else is left
    assert got == sorted(expected(taken)) and len(got) > 200


def test_stages_on_odd_tables(spark):
    docs = spark.createDataFrame(
        [(1, None, None, None, 0), (2, "", "en", "src1", 0), (2, "", "en", "src1", 0), (None, "some text here", "fr", None, 3), (5, "x " * 50_000, "en", "src0", 1)],
        "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in cp.STAGES:
        for d in (docs, docs.limit(0)):
            out = stage(spark, d, SF)
            assert name == "tokens" or out.columns == d.columns
            out.collect()
    assert sorted(str(r.doc_id) for r in cp.near_duplicates(spark, docs, SF).collect()) == ["1", "2", "5", "None"]
    assert public_tokenizers.path("x")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    leaks = spark.createDataFrame([(None, bench), (3, "a " + bench), (3, "clean"), (None, "clean")], "doc_id long, text string")
    assert sorted(str(r.doc_id) for r in cp.decontaminate(spark, leaks, SF).collect()) == ["3", "None"]
    again = spark.createDataFrame([(4, f"t{i} only here", i) for i in (3, 1, 2, 1)], "doc_id long, text string, n int")
    for n in (1, 3):
        assert [tuple(r) for r in cp.near_duplicates(spark, again.repartition(n), SF).collect()] == [(4, "t1 only here", 1)]


def test_stages_with_clashing_names(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = ["score", "_score", "row", "_row", "q", "cut", "_n", "epoch", "domain", "n_tokens", "class_id", "item_id", "label", "node", "text2", "a.b"]
    wide = docs.withColumns({c: F.lit(f"own {c}") for c in names})
    for name in ("quality", "near_duplicates", "decontaminate", "mix"):
        stage = dict(cp.STAGES)[name]
        out = stage(spark, wide, SF)
        assert out.columns == wide.columns
        assert sorted(map(str, stage(spark, docs, SF).collect())) == sorted(map(str, out.select(*docs.columns).collect()))
        assert [tuple(r) for r in out.drop(*docs.columns).distinct().collect()] == [tuple(f"own {c}" for c in names)]


def test_fit_counts_repeated_rows_once(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    one, two = (gbdt.fit(d, labels) for d in (docs, docs.unionAll(docs)))
    assert (one.values == two.values).all() and (one.cuts == two.cuts).all() and one.base == two.base
