"""Benchmark decontamination by spaced seeds.

Fixed masks select some of the words in a window and ignore the others, so that a window
with substituted words still hashes like the benchmark's where the mask looks. Hashes of
training windows meet those of benchmark windows; each meeting fixes a diagonal, on which
the two word sequences are compared outwards from the hit: a match scores 1, a
substitution -2, and the best segment counts. A document is reported with an item if that
segment has ``MIN_MATCHED`` equal words and at least ``MIN_IDENTITY`` of its words are
equal. Of an item of 9 to 17 words, ``MIN_IDENTITY`` of all its words must be equal on the
diagonal instead; three neighbours among these are always equal, so that such items are
found by every three words. Items below 9 words must be found whole.

The benchmark is the stated query set. Its distinct texts are taken in blocks of bounded
size, one after the other, and every block meets all documents, so that no document is
shuffled however large either side is and the driver holds one block at a time.
"""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm.common import claim, ensure_importable, materialize, release, slices

#: Weight 6 each, so that about a word in three of a window may be substituted.
MASKS = ["111001011", "1101010011", "110010001101"]
MIN_MATCHED, MIN_IDENTITY = 13, 0.75
#: Lengths of items that are judged as a whole, and the seed that finds all of them.
WHOLE, WHOLE_MASK = range(9, 18), "111"
#: Characters of benchmark text in a block, which bounds what is broadcast.
BLOCK_CHARS = 8_000_000
#: Meetings of equal seeds that are held at a time.
STEP = 2_000_000
OVERLAPS = "array<struct<item:long,matched:long,length:long,doc_start:long,item_start:long>>"
_ODD = np.uint64(0x9E3779B97F4A7C15) * np.arange(3, 67, 2, dtype=np.uint64) | np.uint64(1)


def words_of(text: str) -> list[str]:
    return text.lower().split()


def _hashes(words: list[str]) -> np.ndarray:
    # Python's own hash: the index is built in the worker that reads it
    return np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)


def _windows(h: np.ndarray, mask: str) -> np.ndarray:
    n = len(h) - len(mask) + 1
    out = np.zeros(max(0, n), np.uint64)
    if n > 0:
        for k, c in enumerate(mask):
            if c == "1":
                out += h[k : k + n] * _ODD[k]
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
    return out


class Index:
    """Seeds of benchmark items, with a bitmap before the exact lookup."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids = [i for i, _ in items]
        self.words = [words_of(t or "") for _, t in items]
        self.hashed = [_hashes(w) for w in self.words]
        lengths = {len(w) for w in self.words if 0 < len(w) < min(map(len, MASKS))}
        self.masks = [(m, None) for m in MASKS] + [("1" * n, [n]) for n in sorted(lengths)] + [(WHOLE_MASK, WHOLE)]
        self.seeds = []
        for mask, only in self.masks:
            keys, item, pos = [], [], []
            for i, w in enumerate(self.words):
                if only is None or len(w) in only:
                    k = _windows(self.hashed[i], mask)
                    keys.append(k)
                    item.append(np.full(len(k), i))
                    pos.append(np.arange(len(k)))
            keys = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
            order = np.argsort(keys, kind="stable")
            bits = max(16, min(26, int(len(keys)).bit_length() + 6))
            bitmap = np.zeros(1 << bits, bool)
            bitmap[(keys & np.uint64((1 << bits) - 1)).astype(np.int64)] = True
            self.seeds.append((mask, keys[order], np.concatenate(item)[order] if item else order, np.concatenate(pos)[order] if pos else order, bitmap, np.uint64((1 << bits) - 1)))

    def hits(self, h: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Rows (text, item, place of the item's first word among all words) of the seed hits, once each.

        However often a seed occurs on both sides, at most STEP meetings are held besides
        the distinct rows.
        """
        longest = max(map(len, self.words), default=0)
        span = len(h) + longest + 1
        found = np.zeros(0, np.int64)
        for mask, keys, item, pos, bitmap, low in self.seeds:
            w = _windows(h, mask)
            if not len(w) or not len(keys):
                continue
            at = np.flatnonzero(bitmap[(w & low).astype(np.int64)])
            at = at[doc[at] == doc[at + len(mask) - 1]]
            lo, hi = np.searchsorted(keys, w[at], "left"), np.searchsorted(keys, w[at], "right")
            at, lo, n = at[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
            ends = np.cumsum(n)
            a = 0
            while a < len(at):
                b = max(a + 1, int(np.searchsorted(ends, ends[a] - n[a] + STEP, "right")))
                m = n[a:b]
                own = np.repeat(np.arange(a, b), m)
                seed = lo[own] + np.arange(len(own)) - np.repeat(np.cumsum(m) - m, m)
                p = at[own]
                found = np.union1d(found, (doc[p] * len(self.ids) + item[seed]) * span + (p - pos[seed] + longest))
                a = b
        pair, place = np.divmod(found, span)
        return np.stack([*np.divmod(pair, max(1, len(self.ids))), place - longest], axis=1)


def best_segment(equal: np.ndarray) -> tuple[int, int, int]:
    """Start, end and equal words of the segment with the highest score."""
    score = np.concatenate([[0], np.cumsum(np.where(equal, 1, -2))])
    low = np.minimum.accumulate(score)
    end = int((score - low).argmax())
    start = int(score[: end + 1].argmin())
    return start, end, int(equal[start:end].sum())


_indexes: dict = {}


def overlaps(index: Index, texts: list[str]) -> list[list[tuple]]:
    """Per text: (item id, equal words, length, first word in the text, first word in the item)
    of the best segment with every item that it overlaps, by item id."""
    out: list[list[tuple]] = []
    for i, j in slices(texts, 2_000_000):
        words: list[str] = []
        counts = []
        for t in texts[i:j]:
            w = words_of(t)
            words += w
            counts.append(len(w))
        first, h = np.cumsum(counts) - counts, _hashes(words)
        best: dict[tuple[int, int], tuple] = {}
        for d, k, at in index.hits(h, np.repeat(np.arange(j - i), counts)).tolist():
            item, lo, hi = index.words[k], int(first[d]), int(first[d]) + counts[d]
            q = max(0, lo - at)  # words of the item before the text begins
            n = min(len(item) - q, hi - at - q)
            equal = index.hashed[k][q : q + n] == h[at + q : at + q + n]
            if len(item) in WHOLE:
                same = np.flatnonzero(equal).tolist()
                s, e, m = (same[0], same[-1] + 1, len(same)) if same else (0, 0, 0)
                near = m >= MIN_IDENTITY * len(item)
            else:
                s, e, m = best_segment(equal)
                near = m >= min(MIN_MATCHED, len(item)) and m >= MIN_IDENTITY * (e - s)
            if near and m == sum(item[q + x] == words[at + q + x] for x in range(s, e)):  # the words themselves
                best[d, k] = max(best.get((d, k), (0,)), (m, s - e, -(at + q + s - lo), -(q + s)))
        rows: list[list[tuple]] = [[] for _ in range(i, j)]
        for (d, k), (m, neg, p, q) in sorted(best.items(), key=lambda x: (x[0][0], index.ids[x[0][1]])):
            rows[d].append((index.ids[k], m, -neg, -p, -q))
        out += rows
    return out


def find_overlaps(spark: SparkSession, items: list[tuple[int, str]], text: Column) -> tuple[Column, Broadcast]:
    """Column of the overlaps of ``text`` with one block of items, and what it broadcasts."""
    ensure_importable(spark)
    shared = spark.sparkContext.broadcast(items)
    key = uuid.uuid4().hex

    @F.pandas_udf(OVERLAPS)
    def run(column):
        import pandas as pd

        claim("decontam", _indexes)
        if _indexes.get("key") != key:
            _indexes.clear()
            _indexes.update(key=key, index=Index(shared.value))
        names = ("item", "matched", "length", "doc_start", "item_start")
        return pd.Series([[dict(zip(names, r)) for r in rows] for rows in overlaps(_indexes["index"], [t or "" for t in column])], dtype=object)

    return run(text), shared


def _blocks(benchmark: DataFrame, block_chars: int):
    """Distinct texts of the benchmark, named by their least item, in blocks of bounded size."""
    texts = benchmark.where("text is not null and item_id is not null").groupBy("text").agg(F.min("item_id").cast("long").alias("item"))
    n = 1 + int((texts.agg(F.sum(F.length("text"))).first()[0] or 0) // block_chars)
    for b in range(n):
        part = texts.where(F.pmod(F.xxhash64("text"), F.lit(n)) == b) if n > 1 else texts
        yield n, [(r.item, r.text) for r in part.collect()]


def contamination(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per document and benchmark item that overlap, over all documents: doc_id, item_id,
    matched, length, doc_start, item_start (in words).

    Null and empty texts and items overlap nothing; items of one text are reported each;
    repeated rows are reported each; rows without doc_id are reported without; texts of any
    length are read whole; other columns are not read; an empty benchmark gives no rows.
    """
    slim, found = docs.select(F.col("doc_id").cast("long"), "text"), []
    for n, items in _blocks(benchmark, block_chars):
        column, shared = find_overlaps(docs.sparkSession, items, F.col("text"))
        rows = slim.select("doc_id", F.inline(column))
        if n > 1:  # one block at a time
            rows = materialize(rows, "overlaps")
            shared.destroy()
        found.append(rows)
    named = benchmark.where("text is not null and item_id is not null").select(F.col("item_id").cast("long"), F.sha2("text", 256).alias("sha"))
    named = named.join(named.groupBy("sha").agg(F.min("item_id").alias("item")), "sha").select("item", "item_id")
    return reduce(DataFrame.unionAll, found).join(named, "item").select("doc_id", "item_id", "matched", "length", "doc_start", "item_start")


def clean(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` that overlap no item, with all their columns, whatever they are
    named; rows are judged one by one, with or without doc_id."""
    kept = docs.select("text", F.struct("*").alias("row"))
    for n, items in _blocks(benchmark, block_chars):
        column, shared = find_overlaps(docs.sparkSession, items, F.col("text"))
        left = kept.where(F.size(column) == 0)
        if n > 1:
            left = materialize(left, "clean")
            shared.destroy()
            release(kept)
        kept = left
    return kept.select("row.*")
