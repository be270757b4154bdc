import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.llm import chat, gbdt, langid, queries, rules

SF = "/root/testdata/sf0.01"
TABLES = ["documents", "labels", "benchmark", "conversations"]


def duck(sql, **frames):
    con = duckdb.connect()
    for t in TABLES:
        if t in frames:
            con.register(t, frames[t])
        else:
            con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con.execute(sql)


def same(df, sql, **frames):
    got = df.toPandas()
    want = duck(sql, **frames).df()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    plain = lambda x: None if x is None or x != x else int(x) if isinstance(x, float) and x == int(x) else x
    key = lambda f: sorted(repr([plain(x) for x in r]) for r in f[cols].astype(object).where(f[cols].notna(), None).itertuples(index=False, name=None))
    assert key(got) == key(want)


def test_op4_equals_sql(spark):
    same(queries.op4_chat_format(spark, SF), chat.ORACLE)


def test_chat_odd_turns(spark):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [(1, 1, "assistant", None), (1, 0, None, "<|x <\\| <\\\\| a\\|"), (None, None, "assistant", "é\u0000日本🎉"), (2, 0, "assistant", "x" * 50_000),
            (2, 0, "assistant", "x" * 50_000), (3, 0, "<|im_end|>", "<|endoftext|> <|im_start|>"), (4, 5, "user", ""),
            (5, 1, "user", "zebra"), (5, 1, "user", "apple"), (5, 1, "assistant", "zebra"), (5, 1, "assistant", "apple"), (5, None, "user", "b"), (5, None, "user", "a")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, ids string")
    same(chat.read_back(chat.format_turns(df, path), path), chat.ORACLE.replace("UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'", "").replace("UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'", ""), conversations=df.toPandas())
    assert chat.read_back(chat.format_turns(df.limit(0), path), path).count() == 0
    for t in ("<|", "<\\|", "<\\\\|a<|", "plain"):
        assert chat.unescape(chat.escape(t)) == t and "<|" not in chat.escape(t)


def test_viterbi_equals_plain_recursion():
    rng = np.random.default_rng(1)
    for n, chunk in ((2, 3), (4, 7), (3, 128)):
        counts = rng.integers(1, 60, 20)
        s = rng.normal(size=(counts.sum(), n)).astype(np.float32) * 4
        path, at = langid.viterbi(s, counts, 3.0, chunk), 0
        for c in counts:
            x = s[at : at + c]
            score = lambda p: sum(x[i, k] for i, k in enumerate(p)) - 3.0 * sum(a != b for a, b in zip(p, p[1:]))
            v, back = x[0].copy(), []
            for r in x[1:]:
                jump = v.max() - 3.0
                back.append(np.where(v >= jump, np.arange(n), v.argmax()))
                v = np.maximum(v, jump) + r
            assert abs(score(path[at : at + c].tolist()) - v.max()) < 1e-3
            at += c


def test_op5_accuracy_and_spans(spark):
    out = queries.op5_language_id(spark, SF).toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    m = out.merge(docs, on="doc_id")
    held = m[m.held_out]
    assert all((zlib.crc32(str(d).encode()) % 3 == 1) == h for d, h in zip(m.doc_id, m.held_out))
    assert (held.lang_pred == held.lang).mean() > 0.97
    model = langid.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    en, fr = docs[docs.lang == "en"].text.iloc[0][:300], docs[docs.lang == "fr"].text.iloc[0][:300]
    odd = spark.createDataFrame([(1, None), (2, "12 !? ²"), (3, en + " " + fr), (4, ""), (5, "日本"), (6, "a " * 30000)], "doc_id long, text string")
    got = {r.doc_id: r for r in langid.identify(odd, model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 4)] == ["und"] * 3
    assert [s.lang for s in got[3].spans][0] == "en" and [s.lang for s in got[3].spans][-1] == "fr"
    assert langid.identify(odd.limit(0), model).count() == 0
    none = langid.fit(odd.selectExpr("doc_id", "text", "cast(null as string) lang"))
    assert {r.lang_pred for r in langid.identify(odd, none).collect()} == {"und"}


def plain_identify(model, text, penalty):
    """Word by word and letter by letter, with dictionaries and a list of paths."""
    import unicodedata

    words, now = [], ""
    for c in unicodedata.normalize("NFC", text).lower() + " ":
        if c.isalpha() and len(now) < 40:
            now += c
        else:
            words += [now] if now else []
            now = c if c.isalpha() else ""
    best = {}  # language: (score, path)
    for w in words:
        names = [next((n for lo, hi, n in langid.SCRIPTS if lo <= ord(c) <= hi), "Other") for c in w]
        allowed = model.scripts.get(max(names, key=names.count), [True] * len(model.langs))
        raw = {}
        for k, lang in enumerate(model.langs):
            if allowed[k] or not any(allowed):
                raw[lang] = sum(float(model.scores[model.grams[g], k]) for n in (1, 2, 3) for i in range(len(w) + 3 - n) if (g := f"^{w}$"[i : i + n]) in model.grams)
        step = {x: max(raw[x] - max(raw.values()), langid.WORD_FLOOR) if x in raw else -1e6 for x in model.langs}
        if not best:
            best = {x: (step[x], [x]) for x in model.langs}
            continue
        top = max(best.values())
        best = {x: (max(best[x][0], top[0] - penalty) + step[x], (best[x] if best[x][0] >= top[0] - penalty else top)[1] + [x]) for x in model.langs}
    if not best:
        return "und", 0.0, {}
    score, path = max(best.values(), key=lambda b: b[0])
    letters = {x: sum(len(w) for w, p in zip(words, path) if p == x) for x in model.langs}
    return max(letters, key=letters.get), max(letters.values()) / sum(letters.values()), letters


def test_op5_equals_plain_version(spark):
    rows = [(1, "the house is over there and we will see it " * 9, "en"), (2, "das haus steht dort und wir werden es sehen " * 9, "de"),
            (3, "дом стоит там и мы увидим его " * 9, "ru"), (4, "το σπίτι είναι εκεί και θα το δούμε " * 9, "el")]
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60")
    fit = spark.createDataFrame(rows, "doc_id long, text string, lang string").unionByName(docs.selectExpr("doc_id + 100", "text", "lang").toDF("doc_id", "text", "lang"))
    model = langid.fit(fit)
    texts = [r.text for r in docs.collect() if len(r.text) < 4000] + [
        "we see das haus steht dort, and the house", "дом house дом", "12 !", "σπίτι και the house is", "x" * 95, "e\u0301te\u0301 here", "日本 the", "xхouse"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in langid.identify(df, model).collect():
        lang, score, letters = plain_identify(model, r.text, langid.SWITCH_PENALTY)
        got = {x: sum(s.letters for s in r.spans if s.lang == x) for x in model.langs}
        assert (r.lang_pred, round(r.score, 9)) == (lang, round(score, 9)) and got == (letters or {x: 0 for x in model.langs}), r.text[:80]
    short = langid.identify(df.withColumn("score", F.lit("own")), model, with_spans=False)
    assert short.columns == ["doc_id", "text", "score", "lang_pred"] and short.where("score between 0 and 1").count() == len(texts)


def test_words_keep_their_marks():
    assert langid.words_of("Cafe\u0301, \u0939\u093f\u0928\u094d\u0926\u0940 x1y") == ["caf\u00e9", "\u0939\u093f\u0928\u094d\u0926\u0940", "x", "y"]
    assert langid.script_of("\u0939\u093f\u0928") == "Devanagari" and langid.script_of("xдом") == "Cyrillic"


def test_rare_language_keeps_its_script(spark):
    """One word in 5,000 is of the rare language."""
    rows = [(1, "the house is over there and we will see it " * 10_000, "en"), (2, "zwyk kuqo vuzy qarw " * 5, "xx")]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.langs == ["en", "xx"] and model.scripts["Latin"] == [True, True]
    odd = spark.createDataFrame([(1, "zwyk kuqo vuzy qarw kuqo"), (2, "we will see the house")], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in langid.identify(odd, model).collect()} == {1: "xx", 2: "en"}


def test_long_run_of_letters_counts_whole(spark):
    rows = [(1, "houses stand here " * 50, "en"), (2, "zwykkuqo vuzyqarw " * 50, "xx")]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    odd = spark.createDataFrame([(1, "houses" * 40 + "zwykkuqo" * 40)], "doc_id long, text string")
    got = langid.identify(odd, model).first()
    assert got.lang_pred == "xx" and [s.lang for s in got.spans] == ["en", "xx"]
    assert [s.letters for s in got.spans] == [240, 320]


def test_op10_held_out_accuracy(spark):
    out = queries.op10_quality_classifier(spark, SF).toPandas().merge(spark.read.parquet(f"{SF}/labels.parquet").toPandas(), on="doc_id")
    held = out[out.held_out]
    assert (held.predicted == held.quality).mean() > 0.95
    assert out.score.between(0, 1).all()
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "\n\n"), (4, "x" * 200_000)], "doc_id long, text string")
    assert gbdt.score(odd, gbdt.grow(np.zeros((0, len(gbdt.NAMES))), np.zeros(0))).where("score = 0.5").count() == 4


def plain_grow(x, y, trees, depth):
    """Boosting with every cut of every column tried by plain sums; a tree as nested tuples."""
    x, y = [list(map(float, r)) for r in x], list(map(float, y))
    edges = [sorted(set(np.quantile([r[j] for r in x], np.linspace(0, 1, gbdt.BINS + 1)[1:-1]).tolist())) for j in range(len(x[0]))]
    p = sum(y) / len(y)
    base = float(np.log(p / (1 - p)))
    margin, out = [base] * len(y), []

    def split(rows, level):
        g, h = [sum(c[i] for i in rows) for c in (grad, curve)]
        if level == depth:
            return -gbdt.RATE * g / (h + gbdt.L2)
        best = (1e-9, None, None)
        for j, cuts in enumerate(edges):
            for cut in cuts:
                left = [i for i in rows if x[i][j] <= cut]
                if min(len(left), len(rows) - len(left)) >= gbdt.MIN_LEAF:
                    gl, hl = [sum(c[i] for i in left) for c in (grad, curve)]
                    gain = gl**2 / (hl + gbdt.L2) + (g - gl) ** 2 / (h - hl + gbdt.L2) - g**2 / (h + gbdt.L2)
                    if gain > best[0] + 1e-9:
                        best = (gain, j, cut)
        _, j, cut = best
        if j is None:
            return split(rows, depth)
        return j, cut, split([i for i in rows if x[i][j] <= cut], level + 1), split([i for i in rows if x[i][j] > cut], level + 1)

    def walk(node, r):
        while isinstance(node, tuple):
            node = node[2] if r[node[0]] <= node[1] else node[3]
        return node

    for _ in range(trees):
        prob = [1 / (1 + np.exp(-m)) for m in margin]
        grad, curve = [a - b for a, b in zip(prob, y)], [a * (1 - a) for a in prob]
        out.append(split(list(range(len(y))), 0))
        margin = [m + walk(out[-1], r) for m, r in zip(margin, x)]
    return lambda r: 1 / (1 + np.exp(-(base + sum(walk(t, r) for t in out))))


def test_op10_equals_plain_trees(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(160, 3)).round(1)
    y = ((x[:, 0] > 0.2) ^ (x[:, 1] > 0) | (rng.random(160) < 0.1)).astype(float)
    got = gbdt.grow(x, y, trees=4, depth=3)
    plain = plain_grow(x, y, 4, 3)
    new = np.concatenate([x, rng.normal(size=(50, 3))])
    assert np.allclose(got.score(new), [plain(r) for r in new.tolist()], atol=1e-9)
    docs = spark.createDataFrame([(1, "A b c", "own"), (1, "A b c", "own"), (2, None, "own")], "doc_id long, text string, score string")
    wide = gbdt.Trees(0.0, np.array([[1]]), np.array([[0.5]]), np.array([[-1.0, 1.0]]))
    s = gbdt.score(docs, wide)
    assert s.columns == docs.columns and sorted(r.score > 0.5 for r in s.collect()) == [False, True, True]
    assert gbdt.score(docs.limit(0), wide).count() == 0
    assert gbdt.fit(docs, spark.createDataFrame([], "doc_id long, quality int")).base == 0


def test_op9_equals_sql(spark):
    same(queries.op9_quality_rules(spark, SF), rules.ORACLE)


def test_rules_odd_texts(spark):
    import pandas as pd

    t = ["", None, "a b c d e a b c d e", "x\n\nx\n \ny\nx", "a b \u000bc", "z " * 3000, "# * $ %\n" * 20, "A B" * 50] * 2
    docs = pd.DataFrame({"doc_id": [*range(len(t) - 2), None, 3], "text": t, "lang": ["en", None] * len(t[::2])}).astype({"doc_id": "Int64"})
    labels = pd.DataFrame({"doc_id": [0, 2, 2, None], "quality": [1, 0, 1, 1], "toxic": [0, 0, 0, 0]}).astype({"doc_id": "Int64", "quality": "Int64"})
    sdocs = spark.createDataFrame([(None if pd.isna(a) else int(a), b, c, 1) for a, b, c in docs.itertuples(index=False)], "doc_id long, text string, lang string, n_words int")
    slabels = spark.createDataFrame([(None if pd.isna(a) else int(a), int(b)) for a, b, _ in labels.itertuples(index=False)], "doc_id long, quality int")
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    same(rules.apply_rules(sdocs, slabels).select(cols), rules.ORACLE, documents=docs, labels=labels)
    assert rules.apply_rules(sdocs.limit(0), slabels).count() == 0


@pytest.mark.parametrize("n,k,p", [(500, 0, 0.0125), (5000, 30, 0.0125), (40, 0, 0.3), (2_000_000, 24_000, 0.0125)])
def test_binomial_tail(spark, n, k, p):
    from math import exp, lgamma, log
    from pyspark.sql import functions as F

    terms = [lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * log(p) + (n - j) * log(1 - p) for j in range(k + 1)]
    want = max(terms) + log(sum(exp(t - max(terms)) for t in terms))
    got = spark.range(1).select(rules.log_tail(F.lit(k), F.lit(n), p)).first()[0]
    assert abs(got - want) < 1e-6 * max(1, abs(want))
