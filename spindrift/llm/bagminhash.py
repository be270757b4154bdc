"""Near-duplicates of word shingles by BagMinHash.

A text is the multiset of its five-word shingles. For every shingle and weight level, a
Poisson process scatters points over time and over the components of the signature; a
component keeps the earliest point of all processes of the text, and two texts agree in a
component with exactly the probability of their weighted Jaccard similarity. Levels are
grouped into dyadic blocks [0,1), [1,2), [2,4), ...: one process runs for a block, with
the block's width as its rate, and a point of a block that the weight covers in part is
placed at a level by further bits, and dropped if that lies above the weight. Only points
that are earlier than the latest component so far are generated, for all texts of a batch
in vector rounds.

Bands of components give bucket keys. Texts of equal words are one node, so that copies
cost a row each and no pair. Each node is first compared with two leaders of its buckets;
the similarity of two whole texts decides. Connected nodes then share a label. Buckets of
two nodes of different labels are pairs to compare, unless they were compared before; larger
buckets that still hold different labels are taken together where they hang together and
have ``TOGETHER`` nodes at most, else one by one, and are cut into blocks of bounded size. For two blocks
of a group, the signatures tell which pairs of different labels may be near (``FLOOR``);
where these are few, they are verified one by one, and where they are many, one matrix
product gives the overlaps of the blocks' whole texts, and only links come out, one for two
labels. A pair that shares a bucket is thus compared, or known to be in one class already.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from spindrift.llm.common import claim, ensure_importable, materialize, parts, release, slices

SHINGLE, THRESHOLD = 5, 0.8
#: 32 bands of 4: a pair at 0.8 misses every band with probability 5e-8.
BANDS, ROWS = 32, 4
M = BANDS * ROWS
#: Components of M that must agree before texts are compared: 5 standard deviations below
#: the mean at 0.8, which a pair at 0.8 misses with probability 2e-6.
FLOOR = int(np.ceil(M * (THRESHOLD - 5 * (THRESHOLD * (1 - THRESHOLD) / M) ** 0.5)))
#: Nodes in a block of a bucket, columns of a matrix product, and likely pairs for a node of
#: a pair of blocks beyond which the blocks' texts are compared there.
BLOCK, COLUMNS, LINEAR = 512, 4096, 4
#: Nodes of buckets that hang together which are compared as one group; the buckets of more
#: are compared each by itself, so that work follows the buckets and not their connection.
TOGETHER = 16 * BLOCK
#: Pairs of one node that a task verifies.
HOT = 1000
#: Document ids up to which they are broadcast to find texts; beyond, the join shuffles.
BROADCAST_IDS = 2_000_000
_U = np.uint64
_K = [_U(k) for k in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _K[1]
    x = (x ^ (x >> _U(27))) * _K[2]
    return x ^ (x >> _U(31))


def words_of(text: str) -> list[str]:
    return text.split()


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[str]]]:
    """Text, hash and count of every distinct shingle; fewer than five words are one shingle."""
    split = [words_of(t) for t in texts]
    counts = np.array([len(w) for w in split], np.int64)
    h = np.fromiter((xxhash.xxh3_64_intdigest(w) for ws in split for w in ws), np.uint64, int(counts.sum()))
    first = np.cumsum(counts) - counts
    n = np.where(counts >= SHINGLE, counts - SHINGLE + 1, np.minimum(counts, 1))
    doc = np.repeat(np.arange(len(texts)), n)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n) + first[doc]
    left = first[doc] + counts[doc] - at
    x = np.zeros(len(doc), np.uint64)
    padded = np.concatenate([h, np.zeros(SHINGLE, np.uint64)])
    for k in range(SHINGLE):
        x += np.where(left > k, padded[at + k], _U(0)) * _K[k]
    x = _mix(x)
    both = _mix(x + doc.astype(np.uint64) * _K[3])  # one key for the pair
    order = np.argsort(both, kind="stable")
    new = np.flatnonzero(np.r_[True, both[order][1:] != both[order][:-1]]) if len(order) else order
    return doc[order][new], x[order][new], np.diff(np.r_[new, len(order)]), split


def signatures(doc: np.ndarray, x: np.ndarray, w: np.ndarray, n_docs: int, m: int = M) -> np.ndarray:
    """BagMinHash of weighted elements (doc, x, w); n_docs x m times of the earliest points."""
    # a row per element and dyadic block that its weight reaches
    blocks = np.where(w > 1, np.ceil(np.log2(np.maximum(w, 2))).astype(np.int64) + 1, 1)
    own = np.repeat(np.arange(len(w)), blocks)
    j = np.arange(len(own)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    start = np.where(j > 0, 1 << np.maximum(j - 1, 0), 0)
    width = np.maximum(start, 1)
    d, weight = doc[own], w[own]
    key = _mix(x[own] + j.astype(np.uint64) * _K[4])
    t = np.zeros(len(d))
    sig = np.full(n_docs * m, np.inf)
    step = 0
    while len(d):
        step += 1
        r = _mix(key + np.array([step], np.uint64) * _K[0])
        t = t - np.log1p(-((r >> _U(11)).astype(np.float64) * 2.0**-53)) / width
        r2 = _mix(r ^ _K[3])
        hit = d * m + (r2 % _U(m)).astype(np.int64)
        level = start + ((r2 >> _U(32)) % width.astype(np.uint64)).astype(np.int64)
        inside = level < weight
        np.minimum.at(sig, hit[inside], t[inside])
        live = t < sig.reshape(n_docs, m).max(axis=1)[d]
        d, key, t, start, width, weight = (a[live] for a in (d, key, t, start, width, weight))
    return sig.reshape(n_docs, m)


def similarity(a: str, b: str) -> float:
    """Weighted Jaccard similarity of two whole texts; 0 if one has no word."""
    doc, x, w, _ = shingles([a, b])
    left, right = dict(zip(x[doc == 0].tolist(), w[doc == 0].tolist())), dict(zip(x[doc == 1].tolist(), w[doc == 1].tolist()))
    low = sum(min(n, right.get(k, 0)) for k, n in left.items())
    return low / max(1, sum(left.values()) + sum(right.values()) - low) if left and right else 0.0


def sign(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """doc_id, content (128 bits of the words, null if none), bands: one bucket key each, and
    16 bits of each component."""
    ensure_importable(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("signatures")
        for b in batches:
            ids, texts = b.column(0), [t or "" for t in b.column(1).to_pylist()]
            for i, j in slices(texts, 1_000_000):
                doc, x, w, split = shingles(texts[i:j])
                bits = signatures(doc, x, w, j - i).view(np.uint64)
                key = np.zeros((j - i, BANDS), np.uint64)
                for k in range(ROWS):
                    key = _mix(key + bits[:, k::ROWS] * _K[k] + np.arange(BANDS, dtype=np.uint64))
                content = [xxhash.xxh3_128_digest(" ".join(ws)) if ws else None for ws in split]
                short = (_mix(bits) & _U(0xFFFF)).astype(np.uint16)
                yield pa.RecordBatch.from_arrays([
                    ids.slice(i, j - i), pa.array(content, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1, dtype=np.int32) * BANDS), pa.array(key.view(np.int64).ravel())),
                    pa.array([short[n].tobytes() for n in range(j - i)], pa.binary()),
                ], ["doc_id", "content", "bands", "sig"])

    return docs.select(F.col("doc_id").cast("long"), F.col(text_col)).mapInArrow(run, "doc_id long, content binary, bands array<long>, sig binary")


@F.pandas_udf(BooleanType())
def _near(a, b):
    import pandas as pd

    return pd.Series([similarity(x, y) >= THRESHOLD for x, y in zip(a, b)], dtype=bool)


@F.pandas_udf(BooleanType())
def _likely(a, b):
    """False where so few components agree that 0.8 is out of the question (5 standard deviations)."""
    import pandas as pd

    same = [int((np.frombuffer(x, np.uint16) == np.frombuffer(y, np.uint16)).sum()) for x, y in zip(a, b)]
    return pd.Series([s >= FLOOR for s in same], dtype=bool)


def _texts(docs: DataFrame, ids: DataFrame, tag: str) -> DataFrame:
    """The texts of ``ids`` (doc_id, distinct); of several texts, the greatest."""
    small = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    found = docs.select("doc_id", "text").join(F.broadcast(ids) if small else ids, "doc_id", "left_semi")
    return materialize(found.groupBy("doc_id").agg(F.max("text").alias("text")), tag)


def overlaps(doc: np.ndarray, x: np.ndarray, w: np.ndarray, n: int) -> np.ndarray:
    """Sums of the lesser counts for every two of n texts, as products of level matrices."""
    out = np.zeros((n, n), np.float32)
    rep = np.repeat(np.arange(len(w)), w)
    level = np.arange(len(rep)) - np.repeat(np.cumsum(w) - w, w)
    _, col, size = np.unique(_mix(x[rep] + level.astype(np.uint64) * _K[4]), return_inverse=True, return_counts=True)
    shared = size[col] > 1
    col, row = np.unique(col[shared], return_inverse=True)[1], doc[rep][shared]
    order = np.argsort(col, kind="stable")
    col, row = col[order], row[order]
    for lo in range(0, int(col[-1]) + 1 if len(col) else 0, COLUMNS):
        a, b = np.searchsorted(col, (lo, lo + COLUMNS))
        dense = np.zeros((n, COLUMNS), np.float32)
        dense[row[a:b], col[a:b] - lo] = 1
        out += dense @ dense.T
    return out


def _links(group):
    """One link for any two labels that have near texts among the rows of a block pair."""
    import pandas as pd

    doc, x, w, _ = shingles(group["text"].tolist())
    n, label, node = len(group), group["label"].to_numpy(), group["node"].to_numpy()
    total = np.bincount(doc, w, n)
    low = overlaps(doc, x, w, n)
    a, b = np.nonzero(np.triu(low >= THRESHOLD * (total[:, None] + total[None, :] - low) - 1e-3, 1))
    other = label[a] != label[b]
    a, b = a[other], b[other]
    exact = low[a, b] / (total[a] + total[b] - low[a, b]) >= THRESHOLD
    out = pd.DataFrame({"a": node[a[exact]], "b": node[b[exact]], "la": label[a[exact]], "lb": label[b[exact]]})
    return out.drop_duplicates(["la", "lb"])[["a", "b"]]


def _blocks(marked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cut the buckets of ``marked`` (key, node, label) into blocks of about BLOCK nodes.

    A label with many nodes in a bucket is a unit of its own, the other labels are one unit;
    units are cut by a hash of the node, so that no task numbers a bucket. Returns the members
    (key, unit, block, node, label) and the pairs of blocks that may hold different labels.
    """
    of_label = marked.groupBy("key", "label").agg(F.count("*").alias("c"))
    of_label = of_label.withColumn("unit", F.when(F.col("c") > BLOCK // 2, F.col("label").cast("string")).otherwise(""))
    units = materialize(of_label.groupBy("key", "unit").agg(F.ceil(F.sum("c") / BLOCK).cast("int").alias("nb")), "units")
    placed = marked.join(of_label.select("key", "label", "unit"), ["key", "label"]).join(units, ["key", "unit"])
    placed = placed.withColumn("block", F.pmod(F.xxhash64("node", "key"), F.col("nb")).cast("int"))
    members = materialize(placed.select("key", "unit", "block", "node", "label"), "members")
    other = units.withColumnsRenamed({"unit": "unit2", "nb": "nb2"})
    both = units.join(other, "key").where("unit < unit2 or (unit = '' and unit2 = '')")
    both = both.select("key", "unit", "unit2", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("block"), "nb2")
    both = both.select("key", "unit", "unit2", "block", F.explode(F.sequence(F.lit(0), F.col("nb2") - 1)).alias("block2"))
    pairs = materialize(both.where("unit <> unit2 or block <= block2"), "block-pairs")
    release(units)
    return members, pairs


_PAIR = ["key", "unit", "block", "unit2", "block2"]


def _sides(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """The members of both blocks of each pair, with ``side``: 0, 1, or 2 where both are one block."""
    same = F.col("unit").eqNullSafe(F.col("unit2")) & (F.col("block") == F.col("block2"))
    first = F.struct(F.col("unit").alias("u"), F.col("block").alias("b"), F.when(same, 2).otherwise(0).alias("side"))
    second = F.struct(F.col("unit2").alias("u"), F.col("block2").alias("b"), F.lit(1).alias("side"))
    sides = pairs.select(*_PAIR, F.inline(F.when(same, F.array(first)).otherwise(F.array(first, second))))
    return sides.join(members.select("key", F.col("unit").alias("u"), F.col("block").alias("b"), "node", "label"), ["key", "u", "b"]).drop("u", "b")


def likely_pairs(sig: np.ndarray, label: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows i, j of one pair of blocks, of different labels, whose signatures may be near."""
    agree = np.zeros((len(sig), len(sig)), np.uint8)
    for k in range(sig.shape[1]):
        agree += sig[:, None, k] == sig[None, :, k]
    ok = (agree >= FLOOR) & (label[:, None] != label[None, :])
    ok &= (side[:, None] == 2) | (side[:, None] != side[None, :])
    return np.nonzero(np.triu(ok, 1))


def _candidates(rows: DataFrame) -> DataFrame:
    """Likely pairs (a, b) of the blocks of ``rows``; a pair of blocks with more than LINEAR
    of them for a node is named instead (a is null), so that what comes out stays linear."""

    def judge(t: pa.Table) -> pa.RecordBatch:
        node, label, side = (t.column(c).to_numpy() for c in ("node", "label", "side"))
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint16).reshape(len(node), M)
        i, j = likely_pairs(sig, label, side)
        name = [t.column(c)[0].as_py() for c in _PAIR]
        n = 1 if len(i) > LINEAR * len(node) else len(i)
        a, b = (pa.nulls(1, pa.int64()),) * 2 if n < len(i) else (pa.array(np.minimum(node[i], node[j])), pa.array(np.maximum(node[i], node[j])))
        return pa.RecordBatch.from_arrays([a, b, *(pa.array([x] * n, f.type) for x, f in zip(name, (t.schema.field(c) for c in _PAIR)))], ["a", "b", *_PAIR])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if held is None else pa.concat_tables([held, t]).combine_chunks()
            cols = [t.column(c).to_numpy() for c in _PAIR]
            new = np.flatnonzero(np.r_[True, np.any([c[1:] != c[:-1] for c in cols], axis=0)]) if t.num_rows else []
            for lo, hi in zip(new[:-1], new[1:]):
                yield judge(t.slice(lo, hi - lo).combine_chunks())
            held = t.slice(new[-1]) if len(new) else held
        if held is not None and held.num_rows:
            yield judge(held.combine_chunks())

    n = parts(rows.sparkSession)
    dealt = rows.select(*_PAIR, "node", "label", "side", "sig").repartition(n, *_PAIR).sortWithinPartitions(*_PAIR, "node")
    return dealt.mapInArrow(run, "a long, b long, key long, unit string, block int, unit2 string, block2 int")


def _rest(crowded: DataFrame, label: DataFrame, star: DataFrame, sigs: DataFrame, docs: DataFrame) -> DataFrame:
    """Links between nodes of different labels that share a bucket; ``star`` are the pairs (a, b) compared before."""
    marked = crowded.select("key", "node").distinct().join(label, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    mixed = marked.groupBy("key").agg(
        F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("n"), F.max("node").alias("a"), F.min("node").alias("b")
    )
    mixed = materialize(mixed.where("lo <> hi"), "mixed-keys")
    # the node of a bucket of two may have met other leaders only
    two_left = mixed.where("n = 2").select("a", "b").distinct().join(star, ["a", "b"], "left_anti")
    marked = materialize(marked.join(mixed.where("n > 2").select("key", "lo"), "key"), "mixed")
    # buckets that hang together are one group as long as that is small, and stay apart beyond
    cluster = components(marked.select(F.col("label").alias("a"), F.col("lo").alias("b")).where("a <> b"))
    grouped = marked.join(cluster.select(F.col("node").alias("label"), F.col("label").alias("cluster")), "label")
    small = grouped.select("cluster", "node").distinct().groupBy("cluster").agg((F.count("*") <= TOGETHER).alias("small"))
    grouped = grouped.join(small, "cluster").select(F.when(F.col("small"), F.xxhash64("cluster")).otherwise(F.col("key")).alias("key"), "node", "label")
    grouped = materialize(grouped.distinct(), "groups")
    members, pairs = _blocks(grouped)
    found = materialize(_candidates(_sides(members, pairs).join(sigs.select("node", "sig"), "node")), "candidates")
    few = found.where("a is not null").select(F.col("b").alias("a"), F.col("a").alias("b")).distinct().join(star, ["a", "b"], "left_anti")
    links = _verify(two_left.union(few).distinct(), sigs, docs, "two")
    # many pairs of one pair of blocks are compared there, on their whole texts
    dense = _sides(members, found.where("a is null").select(*_PAIR))
    texts = _texts(docs, dense.select(F.col("node").alias("doc_id")).distinct(), "rest-texts")
    rows = dense.join(texts.withColumnRenamed("doc_id", "node"), "node")
    out = materialize(rows.select(*_PAIR, "node", "label", "text").groupBy(*_PAIR).applyInPandas(_links, "a long, b long").union(links), "rest")
    release(mixed, links, marked, cluster, grouped, members, pairs, found, texts)
    return out


def _verify(pairs: DataFrame, sigs: DataFrame, docs: DataFrame, tag: str) -> DataFrame:
    """The pairs (a, b) of nodes whose whole texts are near. The pairs of a node b with many
    go to several tasks, each with its own copy of the node's signature and text."""
    pairs = materialize(pairs, tag + "-all")
    many = materialize(pairs.groupBy("b").agg(F.ceil(F.count("*") / HOT).cast("int").alias("k")).where("k > 1"), tag + "-many")
    small = many.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    side = F.broadcast(many) if small else many
    salted = pairs.join(side, "b", "left").select("a", "b", F.pmod(F.xxhash64("a"), F.coalesce("k", F.lit(1))).cast("int").alias("salt"))

    def of_b(rows: DataFrame) -> DataFrame:
        return rows.join(side, "b", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("k", F.lit(1)) - 1))).drop("k")

    sig = sigs.select("node", "sig")
    likely = (
        salted.join(sig.withColumnsRenamed({"node": "a", "sig": "sa"}), "a").join(of_b(sig.withColumnsRenamed({"node": "b", "sig": "sb"})), ["b", "salt"])
        .where(_likely("sa", "sb")).select("a", "b", "salt")
    )
    likely = materialize(likely, tag + "-pairs")
    need = likely.select(F.col("a").alias("doc_id")).union(likely.select("b")).distinct()
    texts = _texts(docs, need, tag + "-texts")
    near = (
        likely.join(texts.withColumnsRenamed({"doc_id": "a", "text": "ta"}), "a")
        .join(of_b(texts.withColumnsRenamed({"doc_id": "b", "text": "tb"})), ["b", "salt"]).where(_near("ta", "tb")).select("a", "b")
    )
    out = materialize(near, tag)
    release(pairs, many, likely, texts)
    return out


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node that each node of ``edges`` (a, b) is connected with.

    Each node hooks to the neighbour of least hash, and edges move to where their ends
    hooked; those that became loops go. The hash makes chains of ids no worse than any.
    """

    def rank(c: str):
        return F.struct(F.xxhash64(c), F.col(c))

    left = materialize(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "edges")
    levels: list[DataFrame] = []
    while not levels or left.limit(1).count():
        near = left.groupBy("a").agg(F.min_by("b", rank("b")).alias("b"))
        hook = near.select(F.col("a").alias("node"), F.when(rank("b") < rank("a"), F.col("b")).otherwise(F.col("a")).alias("parent"))
        hook = hook.join(hook.select(F.col("node").alias("parent"), F.col("parent").alias("top")), "parent").select("node", F.col("top").alias("parent"))
        levels.append(materialize(hook, "hooks"))
        pa_, pb = (levels[-1].withColumnsRenamed({"node": c, "parent": f"p{c}"}) for c in "ab")
        moved = left.join(pa_, "a").join(pb, "b").where("pa <> pb").select(F.col("pa").alias("a"), F.col("pb").alias("b")).distinct()
        moved = materialize(moved, "edges")
        release(left)
        left = moved
    label = levels[0]
    for hook in levels[1:]:
        up = hook.select(F.col("node").alias("parent"), F.col("parent").alias("top"))
        label = label.join(up, "parent", "left").select("node", F.coalesce("top", "parent").alias("parent"))
    least = label.groupBy("parent").agg(F.min("node").alias("label"))
    out = materialize(label.join(least, "parent").select("node", "label"), "labels")
    release(left, *levels)
    return out


def classes(docs: DataFrame) -> DataFrame:
    """doc_id and class_id (the least doc_id of its class) of every row of ``docs``.

    Texts without words are near to nothing and form classes of their own. Rows of one
    doc_id are one document: they share a class, found by the buckets of all their texts and
    verified by the greatest text.
    Rows without doc_id get no class and link nothing. Copies and repeats fall into the
    class of their words. Texts of any length are read whole; other columns are not read. An
    empty table gives an empty table.
    """
    spark = docs.sparkSession
    signed = materialize(sign(docs), "signed")
    known = signed.where("content is not null and doc_id is not null")
    # a node per distinct word sequence, named by its least doc_id
    nodes = materialize(
        known.groupBy("content").agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands"), F.first("sig").alias("sig")), "nodes"
    )
    copies = known.select("doc_id", "content").join(nodes.select("content", "node"), "content").where("doc_id <> node")
    copies = materialize(copies.select(F.col("doc_id").alias("a"), F.col("node").alias("b")).distinct(), "copies")
    keys = nodes.select("node", F.explode("bands").alias("key"))
    leaders = keys.groupBy("key").agg(F.min("node").alias("leader"), F.max("node").alias("last")).where("leader <> last").select("key", "leader")
    crowded = materialize(keys.join(leaders, "key"), "buckets")
    sigs = nodes.groupBy("node").agg(F.max("sig").alias("sig"))
    # of the leaders of its buckets, a node meets the one of most buckets, and the least
    votes = crowded.where("node <> leader").groupBy("node", "leader").agg(F.count("*").alias("n"))
    two = votes.groupBy("node").agg(F.array_distinct(F.array(F.max_by("leader", F.struct("n", -F.col("leader"))), F.min("leader"))).alias("b"))
    star = materialize(two.select(F.col("node").alias("a"), F.explode("b").alias("b")), "star-all")
    edges = _verify(star, sigs, docs, "star")
    label = components(edges)
    more = _rest(crowded, label, star, sigs, docs)
    final = components(edges.union(more).union(copies))
    out = signed.select("doc_id").join(final.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    out = materialize(out.select("doc_id", F.coalesce("label", "doc_id").alias("class_id")).repartition(max(1, parts(spark) // 4)), "classes")
    release(signed, nodes, copies, crowded, star, label, edges, more, final)
    return out
