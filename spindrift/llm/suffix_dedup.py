"""Removal of repeated byte strings by a distributed merge sort of suffixes.

A byte goes if a string of ``LENGTH`` bytes around it also starts earlier (smaller
doc_id, or earlier in the same document). What must be sorted is first narrowed down,
without loss:

* Every window of ``LENGTH`` bytes names one anchor: the place of its least 32-byte hash,
  the leftmost of equals. Equal windows name anchors at equal distance, so that only
  anchors whose 32 bytes occur twice matter. One shuffle of anchor hashes finds these; a
  task reports a hash twice at most, and what it saw more often it already knows.
* The windows of an anchor are cut into pieces of ``PIECE`` neighbours on a grid around
  it. The windows of a piece share a core of ``CORE`` bytes. A piece is shipped as its
  suffix, which is the core and what its windows need on the right, with the few bytes on
  the left as payload.

Each task sorts the suffixes of its pieces, drops those that repeat an earlier piece in
full (their windows are repeats, known at once), front-codes the sorted run against itself and cuts
it at splitters. A merging task combines the runs of its range with a loser tree that
carries the length of the prefix shared with the last output: two candidates are compared
by these lengths alone where they differ, and from the shared prefix on where they agree,
so that no known prefix is read again. The merge yields the lengths of the prefixes that
neighbours share; within a core, these and the left bytes name each window's string, and
all but its first place are repeats.
"""

from __future__ import annotations

import bisect
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import ensure_importable, materialize, parts, release, slices

LENGTH, ANCHOR, PIECE = 100, 32, 17
CORE = LENGTH - PIECE + 1
_SPAN = LENGTH - ANCHOR + 1
#: Bytes of text handled at a time, documents read for splitters, and bytes a merge task gets.
_SLICE, SPLITTER_DOCS, MERGE_BYTES = 1_500_000, 2_000, 12_000_000
_U = np.uint64
_K = [_U(k) for k in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]


def anchors(buf: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of texts that lie end to end in ``buf``: text, place, hash, first and last window."""
    n = len(buf)
    assert n < 1 << 24  # places take 24 bits below
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none, none, none.astype(np.uint64), none, none
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    word = np.lib.stride_tricks.as_strided(padded.view(), (n, 8), (1, 1)).copy().view("<u8").ravel()
    m = n - ANCHOR + 1
    h = word[:m] * _K[0]
    for k in range(1, 4):
        h += word[8 * k : 8 * k + m] * _K[k]
        h ^= h >> _U(32)
    h *= _K[1]
    h ^= h >> _U(31)
    # order by the hash, then from the left
    low = (h & ~_U(0xFFFFFF)) | np.arange(m, dtype=np.uint64)
    width = 1
    while 2 * width <= _SPAN:
        low = np.minimum(low[: len(low) - width], low[width:])
        width *= 2
    if width < _SPAN:
        low = np.minimum(low[: len(low) - (_SPAN - width)], low[_SPAN - width :])
    doc = np.repeat(np.arange(len(size)), np.maximum(size - LENGTH + 1, 0))
    start = np.arange(len(doc)) - np.repeat(np.cumsum(np.maximum(size - LENGTH + 1, 0)) - np.maximum(size - LENGTH + 1, 0), np.maximum(size - LENGTH + 1, 0)) + first[doc]
    if not len(start):
        return none, none, none.astype(np.uint64), none, none
    at = (low[start] & _U(0xFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])])
    last = np.r_[new[1:], len(at)] - 1
    return doc[new], at[new], h[at[new]], start[new], start[last]


def _buffers(texts: list[bytes]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of the texts as one buffer each. A long text takes more than one: its slices
    share LENGTH - 1 bytes, so that each of its windows lies in one. Yields the first text, the offset of
    the slice in it (0 but for long texts), buffer, firsts and sizes."""
    for i, j in slices(texts, _SLICE):
        long = len(texts[j - 1]) > 2 * _SLICE  # it ends its slice; the texts before it go by themselves
        if j - long > i:
            size = np.array([len(t) for t in texts[i : j - long]], np.int64)
            yield i, 0, np.frombuffer(b"".join(texts[i : j - long]), np.uint8), np.cumsum(size) - size, size
        if long:
            for at in range(0, len(texts[j - 1]) - LENGTH + 1, _SLICE):
                piece = np.frombuffer(texts[j - 1][at : at + _SLICE + LENGTH - 1], np.uint8)
                yield j - 1, at, piece, np.zeros(1, np.int64), np.array([len(piece)])


def _encoded(column: pa.Array) -> list[bytes]:
    return [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in column.cast(pa.binary())]


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, at): anchors, as absolute places, whose hash occurs at two places or more.

    Reports of a task carry ``n``: 2 where it saw the hash twice, after which further
    places go out under a random key, since they are known to be repeats.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0).to_numpy(zero_copy_only=False), _encoded(b.column(1))
            for i, base, buf, first, size in _buffers(texts):
                doc, at, h, _, _ = anchors(buf, first, size)
                if not len(doc):
                    continue
                order = np.argsort(h, kind="stable")
                hs = h[order]
                new = np.r_[True, hs[1:] != hs[:-1]]
                lead = np.flatnonzero(new)
                n = np.repeat(np.minimum(np.diff(np.r_[lead, len(hs)]), 2), np.diff(np.r_[lead, len(hs)]))
                where = (at - first[doc] + base)[order]
                key = np.where(new, hs, (hs + where.astype(np.uint64) * _K[2]) ^ _U(0x5555))
                known = np.where(new, n, 3)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(known.astype(np.int8)), pa.array(ids[i + doc[order]], pa.int64()), pa.array(where, pa.int64())],
                    ["h", "n", "doc_id", "at"])

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row of the batch before, whose partner may come yet
        for b in batches:
            h, n, doc, at = (b.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            if held is not None:
                h, n, doc, at = (np.r_[x, y] for x, y in zip(held, (h, n, doc, at)))
            same = h[1:] == h[:-1]
            keep = (n >= 2) | np.r_[same, False] | np.r_[False, same]
            if len(h) > 1:
                keep[-1] = False
                yield pa.RecordBatch.from_arrays([pa.array(doc[keep]), pa.array(at[keep])], ["doc_id", "at"])
                # its own partner came before: mark it as known
                held = h[-1:], np.where(same[-1:], 3, n[-1:]), doc[-1:], at[-1:]
            else:
                held = h, n, doc, at
        if held is not None and held[1][0] >= 2:
            yield pa.RecordBatch.from_arrays([pa.array(held[2]), pa.array(held[3])], ["doc_id", "at"])

    found = docs.select("doc_id", "text").where("doc_id is not null and octet_length(text) >= %d" % LENGTH).mapInArrow(run, "h long, n tinyint, doc_id long, at long")
    n = parts(docs.sparkSession)
    return found.repartition(n, "h").sortWithinPartitions("h").mapInArrow(pick, "doc_id long, at long")


def pieces(buf: np.ndarray, base: int, doc: np.ndarray, at: np.ndarray, lo: np.ndarray, hi: np.ndarray):
    """Cut the windows lo..hi of anchors at ``at`` into pieces on the grid around them.

    Returns anchor row, start of the core, and first and last distance left of the core
    (0..PIECE-1) at which a window of the piece starts.
    """
    near, far = at - hi, at - lo  # distances of the last and the first window
    j0, j1 = near // PIECE, far // PIECE
    row = np.repeat(np.arange(len(at)), j1 - j0 + 1)
    j = np.arange(len(row)) - np.repeat(np.cumsum(j1 - j0 + 1) - (j1 - j0 + 1), j1 - j0 + 1) + j0[row]
    e1 = np.maximum(near[row], j * PIECE) - j * PIECE
    e2 = np.minimum(far[row], j * PIECE + PIECE - 1) - j * PIECE
    return row, at[row] - j * PIECE, e1, e2


_PAYLOAD = np.dtype([("left", "V16"), ("doc", "<i8"), ("tag", "<i8"), ("start", "<i8"), ("e1", "u1"), ("e2", "u1")])


def front_code(rows: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Prefix lengths shared with the row before, and the bytes that follow them."""
    shared = np.zeros(len(rows), np.uint8)
    if len(rows) > 1:
        differ = rows[1:] != rows[:-1]
        first = np.where(differ.any(axis=1), differ.argmax(axis=1), LENGTH)
        shared[1:] = np.minimum(first, np.minimum(size[1:], size[:-1]))
    col = np.arange(LENGTH)
    return shared, rows[(col >= shared[:, None]) & (col < size[:, None])].tobytes()


class Run:
    """A front-coded sorted run, decoded one suffix at a time."""

    def __init__(self, blob: bytes):
        blob = zstandard.ZstdDecompressor().decompress(blob)
        n, m = struct.unpack_from("<II", blob)
        self.shared = blob[8 : 8 + n]
        self.size = blob[8 + n : 8 + 2 * n]
        self.rest, self.at = memoryview(blob)[8 + 2 * n : 8 + 2 * n + m], 0
        self.payload = np.frombuffer(blob, _PAYLOAD, n, 8 + 2 * n + m)
        self.n, self.i, self.now = n, -1, b""

    @staticmethod
    def pack(rows: np.ndarray, size: np.ndarray, payload: np.ndarray) -> bytes:
        shared, rest = front_code(rows, size)
        blob = [struct.pack("<II", len(rows), len(rest)), shared.tobytes(), size.astype(np.uint8).tobytes(), rest, payload.tobytes()]
        return zstandard.ZstdCompressor(level=1).compress(b"".join(blob))

    def step(self) -> int:
        """Go to the next suffix; its prefix shared with the last one, or -1 at the end."""
        self.i += 1
        if self.i >= self.n:
            return -1
        k = self.shared[self.i]
        more = self.size[self.i] - k
        self.now = self.now[:k] + bytes(self.rest[self.at : self.at + more])
        self.at += more
        return k


def merge(runs: list[Run]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Loser tree over runs: the run and row of each output, and the prefix that it shares
    with the output before."""
    k = 1
    while k < len(runs):
        k *= 2
    total = sum(r.n for r in runs)
    order_run, order_row, shared_out = np.zeros(total, np.int32), np.zeros(total, np.int32), np.zeros(total, np.uint8)
    # what each run shares with the last output: -1 when the run is at its end
    lcp = [r.step() for r in runs] + [-1] * (k - len(runs))
    text = [r.now for r in runs] + [b""] * (k - len(runs))

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser's shared prefix becomes that with the winner."""
        la, lb = lcp[a], lcp[b]
        if la != lb:
            return (a, b) if la > lb else (b, a)  # the longer shared prefix is the smaller suffix
        if la < 0:
            return a, b
        x, y = text[a], text[b]
        if x == y:
            lcp[b] = len(y)
            return a, b
        n = min(len(x), len(y))
        u, v = int.from_bytes(x[la:n], "big"), int.from_bytes(y[la:n], "big")
        same = n - ((u ^ v).bit_length() + 7) // 8
        first = (len(x) <= len(y)) if u == v else u < v
        w, l = (a, b) if first else (b, a)
        lcp[l] = same
        return w, l

    tree = [0] * k
    win = [0] * (2 * k)
    win[k:] = range(k)
    for node in range(k - 1, 0, -1):
        win[node], tree[node] = play(win[2 * node], win[2 * node + 1])
    top = win[1] if k > 1 else 0
    for pos in range(total):
        r = runs[top]
        order_run[pos], order_row[pos] = top, r.i
        shared_out[pos] = lcp[top] if pos else 0
        lcp[top] = r.step()
        text[top] = r.now
        node = (top + k) // 2
        while node:
            top, tree[node] = play(top, tree[node])
            node //= 2
    return order_run, order_row, shared_out


def repeats(shared: np.ndarray, payload: np.ndarray) -> np.ndarray:
    """For each piece in merged order and each distance 0..PIECE-1: is its window a repeat?"""
    n = len(payload)
    out = np.zeros((n, PIECE), bool)
    core = np.cumsum(np.r_[True, shared[1:] < CORE]) if n else np.zeros(0, np.int64)
    crowd = np.bincount(core, minlength=1)[core] > 1 if n else np.zeros(0, bool)
    rows = np.flatnonzero(crowd)
    if not len(rows):
        return out
    left = np.frombuffer(payload["left"].tobytes(), np.uint8).reshape(n, 16)
    start = payload["start"]
    for e in range(PIECE):
        r = rows[(payload["e1"][rows] <= e) & (payload["e2"][rows] >= e)]
        if len(r) < 2:
            continue
        # strings of this distance: the right part by shared prefixes, the left part by its e bytes
        right = np.cumsum(np.r_[True, shared[1:] < LENGTH - e])[r]
        near = np.zeros((len(r), 16), np.uint8)
        near[:, 16 - e :] = left[r, 16 - e :]
        a, b = near.view("<u8").T
        order = np.lexsort((start[r] - e, payload["doc"][r], b, a, right))
        q = r[order]
        a, b, right = a[order], b[order], right[order]
        same = (right[1:] == right[:-1]) & (a[1:] == a[:-1]) & (b[1:] == b[:-1])
        # equal places (rows of one doc_id with one text) are no repeats of each other
        head = np.maximum.accumulate(np.where(np.r_[True, ~same], np.arange(len(q)), 0))
        first = (payload["doc"][q] == payload["doc"][q[head]]) & (start[q] == start[q[head]])
        out[q[~first], e] = True
    return out


def _spans(doc, tag, start, flags: np.ndarray):
    """Runs of repeated windows of pieces as byte spans (doc_id, tag, first, end)."""
    f = np.pad(flags[:, ::-1], ((0, 0), (1, 1))).astype(np.int8)  # windows from the left
    step = np.diff(f, axis=1)
    r, c = np.nonzero(step == 1)
    r2, c2 = np.nonzero(step == -1)
    lo = start[r] - (PIECE - 1) + c
    hi = start[r2] - (PIECE - 1) + c2 - 1 + LENGTH
    return doc[r], tag[r], lo, hi


def _span_blob(doc, tag, lo, hi) -> bytes:
    return np.stack([np.asarray(x, np.int64) for x in (doc, tag, lo, hi)]).tobytes()


def _join_spans(doc, tag, lo, hi):
    """Merge spans of a document that touch or overlap."""
    order = np.lexsort((lo, tag, doc))
    doc, tag, lo, hi = (x[order] for x in (doc, tag, lo, hi))
    if not len(doc):
        return doc, tag, lo, hi
    out, top = [0], hi[0]
    ends = []
    for i in range(1, len(doc)):
        if doc[i] != doc[i - 1] or tag[i] != tag[i - 1] or lo[i] > top:
            ends.append(top)
            out.append(i)
            top = hi[i]
        elif hi[i] > top:
            top = hi[i]
    ends.append(top)
    return doc[out], tag[out], lo[out], np.array(ends)


def _piece_rows(batch_ids, tags, texts, chosen):
    """Sorted-run material of texts: rows of suffix bytes, sizes, payload."""
    for i, base, buf, first, size in _buffers(texts):
        doc, at, _, lo, hi = anchors(buf, first, size)
        if not len(doc):
            continue
        if chosen is not None:
            keep = np.zeros(len(doc), bool)
            for d in np.unique(doc):
                sel = doc == d
                keep[sel] = np.isin(at[sel] - first[d] + base, chosen[i + d])
            doc, at, lo, hi = doc[keep], at[keep], lo[keep], hi[keep]
            if not len(doc):
                continue
        row, start, e1, e2 = pieces(buf, base, doc, at, lo, hi)
        n = CORE + PIECE - 1 - e1  # the suffix that the piece's windows need
        padded = np.concatenate([np.zeros(16, np.uint8), buf, np.zeros(LENGTH, np.uint8)])
        suffix = padded[start[:, None] + 16 + np.arange(LENGTH)]
        suffix[np.arange(LENGTH) >= n[:, None]] = 0
        left = padded[start[:, None] + np.arange(16)]
        left[np.arange(16) < 16 - e2[:, None]] = 0
        payload = np.zeros(len(row), _PAYLOAD)
        payload["left"] = np.ascontiguousarray(left).view("V16").ravel()
        d = doc[row]
        payload["doc"], payload["tag"] = batch_ids[i + d], tags[i + d]
        payload["start"], payload["e1"], payload["e2"] = start - first[d] + base, e1, e2
        yield suffix, n, payload


def _order(suffix: np.ndarray, n: np.ndarray) -> np.ndarray:
    flat = suffix.tobytes()
    keys = [flat[i * LENGTH : i * LENGTH + k] for i, k in enumerate(n.tolist())]
    return np.array(sorted(range(len(keys)), key=keys.__getitem__), np.int64)


def splitters(docs: DataFrame, n: int) -> list[bytes]:
    """Cores that cut the order into n ranges; they balance tasks and change no result, because
    pieces of one core lie on one side of each."""
    some = docs.where("octet_length(text) >= %d" % LENGTH).select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SPLITTER_DOCS).distinct()
    chosen = docs.join(F.broadcast(some), "doc_id", "left_semi").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = _encoded(b.column(0))
            zero = np.zeros(len(texts), np.int64)
            for suffix, _, _ in _piece_rows(zero, zero, texts, None):
                some = suffix[:: max(1, len(suffix) // 500)]
                yield pa.RecordBatch.from_arrays([pa.array([r[:CORE].tobytes() for r in some], pa.binary())], ["s"])

    found = sorted(bytes(r.s) for r in chosen.mapInArrow(run, "s binary").collect())
    return [found[len(found) * k // n] for k in range(1, n)] if found else []


def repeated_spans(docs: DataFrame, copies: DataFrame) -> DataFrame:
    """(doc_id, tag, first, end): byte spans of repeats, over ``docs`` (doc_id, tag, text);
    tag tells the texts of one doc_id apart. ``copies`` (doc_id, tag) repeat an earlier
    document whole, and ship no piece."""
    spark = docs.sparkSession
    chosen = materialize(candidates(docs), "anchors")
    total = chosen.count()
    n = int(max(parts(spark), total * 3 * 110 // MERGE_BYTES, 1))
    cuts = spark.sparkContext.broadcast(splitters(docs, n))
    whole = copies.groupBy("doc_id").agg(F.collect_set("tag").alias("whole"))
    by_doc = chosen.groupBy("doc_id").agg(F.collect_list("at").alias("at")).join(whole, "doc_id", "left")

    def ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        size = 0
        edges = cuts.value

        def flush():
            suffix, m, payload = (np.concatenate(x) for x in zip(*held))
            order = _order(suffix, m)
            suffix, m, payload = suffix[order], m[order], payload[order]
            # pieces that repeat an earlier one of this run in full: later places are repeats
            equal = np.r_[False, (suffix[1:] == suffix[:-1]).all(axis=1) & (m[1:] == m[:-1])]
            group = np.cumsum(~equal)
            left = np.frombuffer(payload["left"].tobytes(), "<u8").reshape(-1, 2)
            o = np.lexsort((payload["start"], payload["doc"], payload["e2"], left[:, 0], left[:, 1], group))
            g = np.stack([group[o].astype(np.uint64), left[o, 0], left[o, 1], payload["e2"][o].astype(np.uint64)])
            later = np.r_[False, (g[:, 1:] == g[:, :-1]).all(axis=0)]
            lead = np.maximum.accumulate(np.where(later, 0, np.arange(len(o))))
            twin = (payload["doc"][o] == payload["doc"][o[lead]]) & (payload["start"][o] == payload["start"][o[lead]])
            gone = np.zeros(len(o), bool)
            gone[o] = later & ~twin
            p = payload[gone]
            if len(p):
                flags = (np.arange(PIECE) >= p["e1"][:, None]) & (np.arange(PIECE) <= p["e2"][:, None])
                yield -1, _span_blob(*_join_spans(*_spans(p["doc"], p["tag"], p["start"], flags)))
            suffix, m, payload = suffix[~gone], m[~gone], payload[~gone]
            flat = suffix.tobytes()
            lo = 0
            keys = _Rows(flat, m)
            for k in range(len(edges) + 1):
                hi = bisect.bisect_left(keys, edges[k]) if k < len(edges) else len(m)
                if hi > lo:
                    yield k, Run.pack(suffix[lo:hi], m[lo:hi], payload[lo:hi])
                lo = max(lo, hi)

        def rows(found):
            found = list(found)
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int32()), pa.array([x for _, x in found], pa.binary())], ["part", "blob"])

        for b in batches:
            ids, tags = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            texts, at = _encoded(b.column(2)), [np.array(x, np.int64) for x in b.column(3).to_pylist()]
            for got in _piece_rows(ids, tags, texts, at):
                held.append(got)
                size += len(got[0])
                if size >= 150_000:
                    yield rows(flush())
                    held, size = [], 0
        if held:
            yield rows(flush())

    def combine(key, table):
        blobs = table.column("blob").to_pylist()
        if key[0].as_py() < 0:
            doc, tag, lo, hi = np.concatenate([np.frombuffer(x, np.int64).reshape(4, -1) for x in blobs], axis=1)
        else:
            runs = [Run(x) for x in blobs]
            run, row, shared = merge(runs)
            offset = np.cumsum([0] + [r.n for r in runs])[:-1]
            payload = np.concatenate([r.payload for r in runs])[offset[run] + row]
            flags = repeats(shared, payload)
            some = flags.any(axis=1)
            p = payload[some]
            doc, tag, lo, hi = _join_spans(*_spans(p["doc"], p["tag"], p["start"], flags[some]))
        return pa.table({"doc_id": pa.array(doc), "tag": pa.array(tag), "first": pa.array(lo), "end": pa.array(hi)})

    shipped = docs.join(by_doc, "doc_id").where("whole is null or not array_contains(whole, tag)").select("doc_id", "tag", "text", "at").mapInArrow(ship, "part int, blob binary")
    # spans known at once need no merge and are dealt out by their bytes
    shipped = shipped.withColumn("deal", F.when(F.col("part") < 0, F.pmod(F.xxhash64("blob"), F.lit(n)).cast("int")).otherwise(F.lit(0)))
    merged = shipped.groupBy("part", "deal").applyInArrow(combine, "doc_id long, tag long, first long, end long")
    out = materialize(merged, "spans")
    release(chosen)
    return out


class _Rows:
    """Rows of a flat buffer as a sequence of bytes, for bisect."""

    def __init__(self, flat: bytes, size: np.ndarray):
        self.flat, self.size = flat, size

    def __len__(self):
        return len(self.size)

    def __getitem__(self, i):
        return self.flat[i * LENGTH : i * LENGTH + int(self.size[i])]


def remove(text: bytes, spans: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], bytes]:
    """Maximal spans, and the bytes outside them."""
    joined: list[list[int]] = []
    for a, b in sorted(spans):
        if joined and a <= joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], b)
        else:
            joined.append([a, b])
    kept, at = [], 0
    for a, b in joined:
        kept.append(text[at:a])
        at = b
    kept.append(text[at:])
    return [tuple(x) for x in joined], b"".join(kept)


def dedup(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, spans removed and the text that is left.

    Columns: doc_id, n_bytes, n_removed, n_spans, kept (binary), spans. Null texts are
    empty. Texts shorter than 100 bytes keep all. "Earlier" is a smaller doc_id, or a
    smaller start under the same doc_id, so that repeated rows do not remove each other.
    Rows without doc_id are earlier than none and later than none: they keep all. An
    empty table gives an empty table.
    """
    spark = docs.sparkSession
    ensure_importable(spark)
    all_docs = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).withColumn("tag", F.xxhash64("text"))
    # whole copies of an earlier document go without sorting
    hashed = all_docs.where("doc_id is not null and octet_length(text) >= %d" % LENGTH).select("doc_id", "tag", F.sha2("text", 256).alias("sha"), F.octet_length("text").cast("long").alias("n"))
    least = hashed.groupBy("sha").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).where("first_id < last_id")
    # a table, so that the join below can split a text with very many copies
    least = materialize(least.select("sha", "first_id"), "least")
    copies = hashed.join(least, "sha").where("doc_id > first_id").select("doc_id", "tag", F.lit(0).cast("long").alias("first"), F.col("n").alias("end")).distinct()
    copies = materialize(copies, "copies")
    release(least)
    spans = repeated_spans(all_docs.where("doc_id is not null"), copies)
    per_doc = (
        spans.unionByName(copies).groupBy("doc_id", "tag").agg(F.collect_list(F.struct("first", "end")).alias("found"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, t, found in zip(b.column(0).to_pylist(), _encoded(b.column(1)), b.column(2).to_pylist()):
                joined, kept = remove(t, [(f["first"], f["end"]) for f in found or []])
                out.append((i, len(t), len(t) - len(kept), len(joined), kept, [{"first": a, "end": e} for a, e in joined]))
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "spans"]
            kinds = [pa.int64()] * 4 + [pa.binary(), pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)] if out else [pa.array([], k) for k in kinds], names)

    joined = all_docs.join(per_doc, ["doc_id", "tag"], "left").select("doc_id", "text", "found")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, spans array<struct<first:long,end:long>>")
