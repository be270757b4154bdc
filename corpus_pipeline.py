"""A corpus pipeline in five stages over the tables of a scale-factor folder.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs. All but the last return the columns of
``documents``, and any others that these have, whatever their names. Every stage works on
all rows that its predecessor kept; an empty table stays empty. What a stage writes on its
way is deleted when its result is written.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm import bagminhash, decontam, gbdt, mixing, wavelet
from spindrift.llm.common import materialize, release, scratch, table

#: Document ids up to which a stage's decisions are broadcast; beyond, the join shuffles.
BROADCAST_IDS = 2_000_000


def _without(docs: DataFrame, ids: DataFrame, tag: str) -> DataFrame:
    """``docs`` but for the rows whose doc_id is in ``ids``."""
    ids = materialize(ids.distinct(), tag)
    small = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if small else ids, "doc_id", "left_anti")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.5 or more; it learns from the labels of all rows here.

    Null and empty texts are scored like any other; repeated rows fare alike.
    """
    trees = gbdt.fit(docs, table(spark, sf_dir, "labels"))
    rows = docs.select("text", F.struct("*").alias("row"))
    return gbdt.score(rows, trees).where("score >= 0.5").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class: that of the least doc_id.

    Rows without doc_id stay, as do texts without words. Of rows that repeat a doc_id one
    stays: that of the least text, and of equal texts the one of the least hash of its columns.
    """
    found = bagminhash.classes(docs.select("doc_id", "text"))
    once = _without(docs, found.where("doc_id <> class_id").select("doc_id"), "copies")
    again = materialize(found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    if not again.limit(1).count():
        return once
    # rows that repeat a doc_id are one document; only these are shuffled
    many = once.join(again, "doc_id", "left_semi").select("doc_id", F.struct("text", F.xxhash64("*")).alias("by"), F.struct("*").alias("row"))
    many = many.groupBy("doc_id").agg(F.min_by("row", "by").alias("row")).select("row.*")
    return once.join(again, "doc_id", "left_anti").unionByName(many)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that overlap no benchmark item; each is judged by its own text, with or without doc_id.

    Null and empty texts overlap nothing.
    """
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed sample; a document comes once for each epoch that takes it.

    Tokens are words here. Rows of one doc_id, or without one, are taken together; texts
    without words go with the prefix that they stand in.
    """
    leafed = mixing.leaf_columns(docs.select("doc_id", "lang", "source", F.struct("*").alias("row")))
    slim = materialize(leafed.select("doc_id", *mixing.LEVELS, mixing.count_words(F.col("row.text")).alias("n_tokens")), "mix")
    planned = mixing.plan(slim, mixing.WEIGHTS, mixing.BUDGET_SHARE, mixing.MAX_EPOCHS, mixing.SEED)
    return mixing.take(leafed, planned, mixing.SEED).select("row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shards of token ids, read back: doc_id, start, n_tokens, ids_crc32.

    Null and empty texts give the end id alone; a document that was taken twice comes twice.
    """
    shards = wavelet.write_shards(docs, public_tokenizers.path("word_bpe_49k.json"))
    return wavelet.read_tokens(shards)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("tokens", tokens),
]

#: Trees and signatures have no SQL form; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch(spark) as made:
            out = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
            made.remove(out._spindrift_path)
        release(docs)
        docs = out
    return docs
