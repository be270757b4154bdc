"""Language identification of mixed-language text.

The script ranges that hold most letters of a word narrow its candidate languages, and no
other language can hold the word; each candidate scores the word by its character n-grams; a Viterbi path over the words of a text, which pays a
penalty for every change of language, labels spans. The document's language holds most
letters, its score the share of letters that it holds.

The path is found for all texts of a batch at once: runs of ``CHUNK`` words are solved
for each possible entry state, chained per text, and walked back, so that a text of any
length takes as many vector steps as a run has words, and one for each of its runs.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import ensure_importable, materialize, release, slices

#: First code points of the scripts' main ranges, with the end of each range.
SCRIPTS = [
    (0x41, 0x24F, "Latin"), (0x370, 0x3FF, "Greek"), (0x400, 0x52F, "Cyrillic"), (0x530, 0x58F, "Armenian"),
    (0x590, 0x5FF, "Hebrew"), (0x600, 0x77F, "Arabic"), (0x900, 0x97F, "Devanagari"), (0x980, 0x9FF, "Bengali"),
    (0xB80, 0xBFF, "Tamil"), (0xE00, 0xE7F, "Thai"), (0x10A0, 0x10FF, "Georgian"), (0x1E00, 0x1EFF, "Latin"),
    (0x1F00, 0x1FFF, "Greek"), (0x3040, 0x30FF, "Kana"), (0x3400, 0x9FFF, "Han"), (0xAC00, 0xD7AF, "Hangul"),
]
_STARTS = [s[0] for s in SCRIPTS]
#: Labelled documents that a model is fitted on at most, and n-grams it keeps at most, the
#: most frequent ones: the size of the model.
FIT_DOCS = 20_000
FIT_GRAMS = 60_000
SWITCH_PENALTY = 8.0
WORD_FLOOR = -6.0
WORKER_CACHE = 300_000
CHUNK = 128


def _marks() -> str:
    """The combining marks of the basic plane, as ranges of a character class."""
    marks = [c for c in range(0x300, 0x10000) if unicodedata.category(chr(c))[0] == "M"]
    first = [c for c, before in zip(marks, [0, *marks]) if c != before + 1]
    last = [c for c, after in zip(marks, [*marks[1:], 0]) if after != c + 1]
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in zip(first, last))


#: A word is a run of letters and their marks; a longer run (unspaced scripts) is cut into
#: words of 40 letters, or at the eighth mark. The first pattern does for texts without marks.
_PLAIN = re.compile(r"[^\W\d_]{1,40}")
_MARKED = re.compile(r"[^\W\d_]{1,40}(?:[%s]{1,8}[^\W\d_]{0,8}){0,8}" % _marks())
#: Characters from the first mark on, but for punctuation and symbols.
_HIGH = re.compile("[\u0300-\u1fff\u20d0-\u20f0\u2c00-\uffff]")
_NEVER = np.float32(-1e9)
#: What a language that is no candidate scores; no path can make up for it.
_OUT = np.float32(-1e6)


def words_of(text: str) -> list[str]:
    """Lower-case words of a text in normal form C."""
    if text.isascii():
        return _PLAIN.findall(text.lower())
    text = unicodedata.normalize("NFC", text).lower()
    return (_MARKED if _HIGH.search(text) else _PLAIN).findall(text)


def script_of(word: str) -> str:
    """The script of most letters of a word; of equals, the one that comes first."""
    if word.isascii() or max(word) <= "\u024f":
        return "Latin"
    seen: dict[str, int] = {}
    for x in word:
        c = ord(x)
        i = bisect.bisect_right(_STARTS, c) - 1
        name = SCRIPTS[i][2] if i >= 0 and c <= SCRIPTS[i][1] else "Other"
        seen[name] = seen.get(name, 0) + x.isalpha()
    return max(seen, key=seen.__getitem__)


def grams(word: str) -> list[str]:
    w = f"^{word}$"
    return [w[i : i + n] for n in (1, 2, 3) for i in range(len(w) - n + 1)]


class Model:
    """Plain arrays, so that it can be broadcast: languages, n-grams, log scores, scripts."""

    def __init__(self, langs: list[str], gram_rows: dict[str, int], scores: np.ndarray, scripts: dict[str, list[bool]]):
        self.langs, self.grams, self.scores, self.scripts = langs, gram_rows, scores, scripts


def fit(docs: DataFrame, max_docs: int = FIT_DOCS, max_grams: int = FIT_GRAMS) -> Model:
    """Fit on ``docs`` (doc_id, text, lang), or on ``max_docs`` of them chosen by a hash of doc_id."""
    spark = docs.sparkSession
    ensure_importable(spark)
    known = docs.where("lang is not null and text is not null and doc_id is not null")
    chosen = known.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs).distinct()
    sample = known.join(F.broadcast(chosen), "doc_id", "left_semi").select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for w, n in Counter(words_of(text)).items():
                    words[lang, w] += n
        seen: Counter = Counter()
        for (lang, w), n in words.items():
            seen[lang, "script:" + script_of(w)] += n
            for g in grams(w):
                seen[lang, g] += n
        rows = list(seen.items())
        for i in range(0, len(rows), 20_000):
            part = rows[i : i + 20_000]
            yield pa.RecordBatch.from_pydict({"lang": [k[0] for k, _ in part], "gram": [k[1] for k, _ in part], "n": pa.array([n for _, n in part], pa.int64())})

    found = sample.mapInArrow(count, "lang string, gram string, n long").groupBy("gram", "lang").agg(F.sum("n").alias("n"))
    per_gram = found.groupBy("gram").agg(F.sum("n").alias("all"), F.collect_list(F.struct("lang", "n")).alias("by"))
    per_gram = materialize(per_gram, "grams")
    scripts_rows = per_gram.where(F.col("gram").startswith("script:")).collect()
    rows = per_gram.where(~F.col("gram").startswith("script:")).orderBy(F.desc("all"), "gram").limit(max_grams).collect()
    release(per_gram)
    langs = sorted({b.lang for r in scripts_rows for b in r.by})
    at = {x: i for i, x in enumerate(langs)}
    n = np.zeros((len(rows), len(langs)))
    for i, r in enumerate(rows):
        for b in r.by:
            n[i, at[b.lang]] = b.n
    total = np.maximum(n.sum(axis=0), 1)
    scores = np.log((n + 0.5) / (total + 0.5 * max(1, len(rows)))) if langs else n
    # a language may be written in a script that has a thousandth of its own words
    scripts, words = {}, Counter()
    for r in scripts_rows:
        for b in r.by:
            words[b.lang] += b.n
    for r in scripts_rows:
        share = {b.lang: b.n / words[b.lang] for b in r.by}
        scripts[r.gram[7:]] = [share.get(x, 0) >= 0.001 for x in langs]
    return Model(langs, {r.gram: i for i, r in enumerate(rows)}, scores.astype(np.float32), scripts)


class Scorer:
    """Scores of words under a model, cached in the worker; row 0 is for what has no letter."""

    def __init__(self, model: Model):
        self.m, self.n = model, len(model.langs)
        self.clear()

    def clear(self):
        self.rows: dict[str, int] = {}
        self.table = np.zeros((1024, self.n), np.float32)
        self.weight = np.zeros(1024, np.int64)
        self.used = 1

    def add(self, words: list[str]) -> None:
        m, need = self.m, self.used + len(words)
        if need > len(self.table):
            grown = max(need, 2 * len(self.table))
            self.table = np.concatenate([self.table, np.zeros((grown - len(self.table), self.n), np.float32)])
            self.weight = np.concatenate([self.weight, np.zeros(grown - len(self.weight), np.int64)])
        flat: list[int] = []
        owner: list[int] = []
        for w in words:
            letters = len(w) if w.isalpha() else sum(c.isalpha() for c in w)
            if not letters:
                self.rows[w] = 0
                continue
            r = self.rows[w] = self.used
            self.used += 1
            self.weight[r] = letters
            got = [g for g in map(m.grams.get, grams(w)) if g is not None]
            flat += got
            owner += [r] * len(got)
            if (allowed := m.scripts.get(script_of(w))) and any(allowed) and not all(allowed):
                self.table[r] = np.where(allowed, 0, _OUT)
        if flat:
            lo = min(owner)
            s = np.zeros((self.used - lo, self.n), np.float32)
            own = np.array(owner) - lo
            picked = m.scores[flat]
            for k in range(self.n):
                s[:, k] = np.bincount(own, picked[:, k], self.used - lo)
            out = self.table[lo : self.used] < 0
            s = np.maximum(s - np.where(out, _NEVER, s).max(axis=1, keepdims=True), WORD_FLOOR)
            self.table[lo : self.used] = np.where(out, _OUT, s)

    def lookup(self, words: list[str]) -> np.ndarray:
        found = list(map(self.rows.get, words))
        if None in found:
            if len(self.rows) > WORKER_CACHE:
                self.clear()
                found = [None] * len(words)
            self.add(list(dict.fromkeys(w for w, r in zip(words, found) if r is None)))
            found = list(map(self.rows.__getitem__, words))
        return np.array(found, np.int64)


def viterbi(scores: np.ndarray, counts: np.ndarray, penalty: float, chunk: int = CHUNK) -> np.ndarray:
    """Best state of every word; ``counts`` are the words of each text, end to end."""
    total, n = scores.shape
    path = np.zeros(total, np.int64)
    if not total or n < 2:
        return path
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    runs = -(-counts // chunk)
    text_of = np.repeat(np.arange(len(counts)), runs)
    order = np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
    begin = first[text_of] + order * chunk
    size = np.minimum(chunk, first[text_of] + counts[text_of] - begin)
    n_runs = len(begin)

    # best scores of each run from each entry state to each exit state
    best = np.full((n_runs, n, n), _NEVER, np.float32)
    best[:, np.arange(n), np.arange(n)] = 0
    steps = int(size.max())
    for t in range(steps):
        live = size > t
        row = scores[np.where(live, begin + t, 0)]
        new = np.maximum(best, best.max(axis=2, keepdims=True) - penalty) + row[:, None, :]
        best = np.where(live[:, None, None], new, best)

    # chain the runs of each text
    start_of = np.cumsum(runs) - runs
    busy = np.argsort(-runs, kind="stable")
    v = np.zeros((len(counts), n), np.float32)
    came = np.zeros((n_runs, n), np.int64)
    most = int(runs.max())
    alive = [busy[: np.count_nonzero(runs > k)] for k in range(most)]
    for k in range(most):
        who = alive[k]
        cand = v[who][:, :, None] + best[start_of[who] + k]
        came[start_of[who] + k] = cand.argmax(axis=1)
        v[who] = cand.max(axis=1)
        v[who] -= v[who].max(axis=1, keepdims=True)
    leave, enter = np.zeros(n_runs, np.int64), np.zeros(n_runs, np.int64)
    state = v.argmax(axis=1)
    for k in range(most - 1, -1, -1):
        who = alive[k]
        at = start_of[who] + k
        leave[at] = state[who]
        enter[at] = state[who] = came[at, state[who]]

    # once more with the entry known, keeping the way back
    v = np.full((n_runs, n), _NEVER, np.float32)
    v[np.arange(n_runs), enter] = 0
    back = np.zeros((steps, n_runs, n), np.int8)
    for t in range(steps):
        live = size > t
        top = v.argmax(axis=1)
        jump = v.max(axis=1, keepdims=True) - penalty
        back[t] = np.where(v >= jump, np.arange(n), top[:, None])
        v = np.where(live[:, None], np.maximum(v, jump) + scores[np.where(live, begin + t, 0)], v)
    state = leave
    for t in range(steps - 1, -1, -1):
        live = np.flatnonzero(size > t)
        path[begin[live] + t] = state[live]
        state = state.copy()
        state[live] = back[t, live, state[live]]
    return path


_scorers: dict = {}


def _label(scorer: Scorer, texts: list[str], penalty: float):
    """Words of the texts end to end: their counts, languages and letters."""
    words: list[str] = []
    counts = []
    for t in texts:
        found = words_of(t)
        words += found
        counts.append(len(found))
    rows = scorer.lookup(words)
    counts = np.array(counts, np.int64)
    some = counts > 0
    path = viterbi(scorer.table[rows], counts[some], penalty)
    return counts, path, scorer.weight[rows]


def identify(df: DataFrame, model: Model, text_col: str = "text", penalty: float = SWITCH_PENALTY, with_spans: bool = True) -> DataFrame:
    """Append lang_pred, score and spans (first word, end word, language, letters of each);
    without ``with_spans``, the spans are not listed.

    A text that is null or has no letter gets ``und``, score 0 and no span, as does every
    text if no language was learned. Equal totals go to the first language by name. Texts
    of any length are read whole, in runs of words. Columns named like the new ones are
    replaced; rows are judged one by one, so repeated rows agree.
    """
    spark = df.sparkSession
    ensure_importable(spark)
    shared = spark.sparkContext.broadcast(model)
    key = uuid.uuid4().hex
    new_cols = ["lang_pred", "score", *(["spans"] if with_spans else [])]

    @F.pandas_udf("lang_pred string, score double" + (", spans array<struct<first:int,end:int,lang:string,letters:long>>" if with_spans else ""))
    def run(text):
        import pandas as pd

        if _scorers.get("key") != key:
            _scorers.clear()
            _scorers.update(key=key, scorer=Scorer(shared.value))
        scorer = _scorers["scorer"]
        langs, n = scorer.m.langs, scorer.n
        preds, scores, spans = [], [], []
        texts = [t or "" for t in text]
        for i, j in slices(texts, 1_500_000):
            if not langs:
                preds += ["und"] * (j - i)
                scores += [0.0] * (j - i)
                spans += [[] for _ in range(i, j)]
                continue
            counts, path, weight = _label(scorer, texts[i:j], penalty)
            doc = np.repeat(np.arange(j - i), counts)
            letters = np.bincount(doc * n + path, weight, (j - i) * n).reshape(-1, n)
            total = letters.sum(axis=1)
            top = letters.argmax(axis=1)
            preds += [langs[k] if s else "und" for k, s in zip(top, total)]
            scores += (letters.max(axis=1) / np.maximum(total, 1)).tolist()
            if with_spans:
                spans += _spans(langs, counts, doc, path, weight)
        return pd.DataFrame(dict(zip(new_cols, (preds, scores, spans))))

    name = f"_langid_{key}"
    return df.withColumn(name, run(F.col(text_col))).withColumns({c: F.col(name)[c] for c in new_cols}).drop(name)


def _spans(langs: list[str], counts: np.ndarray, doc: np.ndarray, path: np.ndarray, weight: np.ndarray) -> list[list[dict]]:
    new = np.flatnonzero(np.r_[True, (path[1:] != path[:-1]) | (doc[1:] != doc[:-1])]) if len(path) else np.zeros(0, np.int64)
    sums = np.add.reduceat(weight, new) if len(new) else new
    ends = np.r_[new[1:], len(path)]
    base = np.cumsum(counts) - counts
    by: list[list[dict]] = [[] for _ in counts]
    for a, e, s in zip(new.tolist(), ends.tolist(), sums.tolist()):
        d = doc[a]
        by[d].append({"first": int(a - base[d]), "end": int(e - base[d]), "lang": langs[path[a]], "letters": s})
    return by
