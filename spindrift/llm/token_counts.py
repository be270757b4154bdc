"""Token counts by a two-tier, map-side lookup of pre-token lengths.

A piece model with byte fallback merges no pair across a word mark that follows other
characters, nor across a line feed that only the byte fallback covers. The count of a
text is therefore the sum of the counts of its pre-tokens: words split at single spaces,
and stretches that follow a line feed. Both facts are checked against the vocabulary
when a worker opens the model; texts with other spacing, or a model without these
properties, are encoded whole.

Tier one is a table of the most frequent pre-tokens and their lengths, broadcast in a
compact form of proven size (``hot_size`` entries). Which pre-tokens are frequent is learned
from a bounded sample of ``sample_docs`` documents, whose summaries the driver adds up. Tier
two is a cache in each Python worker that the library fills. No pre-token is shuffled; every
text is counted whole, and no count depends on either tier.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import ensure_importable

#: Entries of the broadcast table, documents that it is learned from at most (about), parts
#: that these are summed up in, and entries of a worker's cache.
HOT_SIZE = 50_000
SAMPLE_DOCS = 10_000
SAMPLE_PARTS = 6
WORKER_CACHE = 400_000

_open: dict = {}


class PieceCounter:
    """Counts of one sentencepiece model, with the worker's cache."""

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.vocab_size())]
        plain = [p for i, p in enumerate(pieces) if not self.sp.is_byte(i)]
        # decomposable: marks only lead a piece, and no piece holds a line feed
        self.decomposes = (
            not any("▁" in p.lstrip("▁") or "\n" in p for p in plain)
            and self.sp.encode("a\n b", out_type=str)[0].startswith("▁")
            and len(self.sp.encode("\n")) == 2
        )
        self.cache: dict[str, int] = {}

    def whole(self, text: str) -> int:
        return len(self.sp.encode(text, num_threads=1))

    def unit(self, word: str) -> int:
        """Tokens of a pre-token; a leading line feed stands for a missing word mark."""
        n = len(self.sp.encode(word))
        return n - 1 if word[0] == "\n" else n

    @staticmethod
    def regular(text: str) -> bool:
        return not (
            "  " in text or " \n" in text or "▁" in text or text[0] in " \n" or text[-1] == " "
        )

    @staticmethod
    def pretokens(text: str) -> list[str]:
        return text.replace("\n", " \n").split(" ")

    def count(self, text: str, hot: dict[str, int]) -> int:
        if not text:
            return 0
        if not self.decomposes or not self.regular(text):
            return self.whole(text)
        total, cache = 0, self.cache
        words = self.pretokens(text)
        lengths = list(map(hot.get, words))
        if None not in lengths:
            return sum(lengths)
        for w, n in zip(words, lengths):
            if n is None:
                n = cache.get(w)
                if n is None:
                    n = self.unit(w)
                    if len(w) <= 64:
                        if len(cache) >= WORKER_CACHE:
                            cache.clear()
                        cache[w] = n
            total += n
        return total


def counter(path: str) -> PieceCounter:
    if path not in _open:
        _open[path] = PieceCounter(path)
    return _open[path]


def _summaries(model: str, keep: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, seen = counter(model), Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                if t and c.regular(t):
                    seen.update(w for w in c.pretokens(t) if 0 < len(w) <= 64)
            if len(seen) > 8 * keep:  # bounded whatever the task reads
                seen = Counter(dict(seen.most_common(4 * keep)))
        top = seen.most_common(keep)
        yield pa.RecordBatch.from_pydict({"w": [w for w, _ in top], "n": pa.array([n for _, n in top], pa.int64())})

    return run


def hot_lengths(texts: DataFrame, model: str, hot_size: int = HOT_SIZE, sample_docs: int = SAMPLE_DOCS) -> dict[str, int]:
    """The broadcast tier: at most ``hot_size`` pre-tokens of at most 64 characters, frequent
    in a sample of about ``sample_docs`` of ``texts`` (one column)."""
    c = counter(model)
    total = texts.count() if c.decomposes else 0
    if not total:
        return {}
    sample = texts if total <= sample_docs else texts.sample(sample_docs / total, seed=7)
    seen: Counter = Counter()
    # only the sample's texts move, so that the driver gets SAMPLE_PARTS summaries of hot_size entries
    for r in sample.repartition(SAMPLE_PARTS).mapInArrow(_summaries(model, hot_size), "w string, n long").collect():
        seen[r.w] += r.n
    top = sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:hot_size]
    return {w: c.unit(w) for w, _ in top}


def count_tokens(
    df: DataFrame, model: str, text_col: str = "text", hot_size: int = HOT_SIZE, out_col: str = "n_tokens", sample_docs: int = SAMPLE_DOCS
) -> DataFrame:
    """Append ``out_col``, the tokens of ``text_col`` under a sentencepiece model.

    Null and empty texts have 0 tokens; texts of any length are counted whole; repeated
    rows are counted each; other columns pass through unless one is named ``out_col``,
    which is replaced; an empty table gives an empty table.
    """
    spark = df.sparkSession
    ensure_importable(spark)
    hot = spark.sparkContext.broadcast(hot_lengths(df.select(F.col(text_col)), model, hot_size, sample_docs))

    @F.pandas_udf("long")
    def n_tokens(text):
        c = counter(model)
        table = hot.value
        return text.map(lambda t: c.count(t, table) if t else 0).astype("int64")

    return df.withColumn(out_col, n_tokens(F.coalesce(F.col(text_col), F.lit(""))))
