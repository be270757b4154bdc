"""Token ids as wavelet matrices: one succinct, self-contained image per shard.

An image stores the ids of consecutive documents as bit planes, from the highest bit
down. Each plane holds one bit of every id, in the order that the planes above leave;
zeros go first, ones after them, both keeping their order. Planes are cut into blocks of
``BLOCK_BITS`` bits that are compressed one by one; a directory in the image holds, for each
block, the ones before it, its place and its checksum. :class:`Image` answers rank from the
directory and one block, and opens no block that a question does not touch: access to a
token opens one block of each plane, a count two.
"""

from __future__ import annotations

import json
import struct
import sys
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindrift.llm.common import claim, ensure_importable, materialize, parts

MAGIC = b"WVM2"
END_ID = 2
#: Tokens after which a shard is closed; a longer document makes a longer shard.
SHARD_TOKENS = 2_000_000
WORKER_CACHE = 600_000
BLOCK_BITS = 1 << 18


def build(ids: np.ndarray) -> tuple[list[np.ndarray], list[int]]:
    """Bit planes of ids, packed from the low bit of each byte, and the zeros of each."""
    levels = max(1, int(ids.max()).bit_length()) if ids.size else 1
    cur = ids.astype(np.uint16 if levels <= 16 else np.uint32)
    planes, zeros = [], []
    for b in range(levels - 1, -1, -1):
        bit = (cur >> b) & 1 != 0
        planes.append(np.packbits(bit, bitorder="little"))
        low = cur[~bit]
        zeros.append(int(low.size))
        cur = np.concatenate([low, cur[bit]])
    return planes, zeros


def pack(doc_ids: list, lengths: list[int], ids: np.ndarray) -> bytes:
    """An image: magic, header, the table of documents, the directory, then the blocks."""
    planes, zeros = build(ids)
    z = zstandard.ZstdCompressor(level=1)
    docs = pa.RecordBatch.from_pydict({"doc_id": pa.array(doc_ids, pa.int64()), "n": pa.array(lengths, pa.int64())})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, docs.schema) as w:
        w.write_batch(docs)
    step, blocks, ones = BLOCK_BITS // 8, [], []
    for plane in planes:
        cut = [plane[i : i + step] for i in range(0, plane.size, step)]
        ones.append(np.cumsum([0, *(int(np.bitwise_count(c).sum(dtype=np.int64)) for c in cut)]))
        blocks += [z.compress(c.tobytes()) for c in cut]
    directory = np.concatenate([
        np.array(ones, "<i8").ravel(), np.cumsum([0, *map(len, blocks)]).astype("<i8"), np.array(list(map(zlib.crc32, blocks)), "<i8")])
    tables = [z.compress(sink.getvalue().to_pybytes()), z.compress(directory.tobytes())]
    head = json.dumps({"n": int(ids.size), "zeros": zeros, "bits": BLOCK_BITS, "sizes": [len(t) for t in tables], "crc": [zlib.crc32(t) for t in tables]}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(head)), head, *tables, *blocks])


class Image:
    """Access, rank, select and occurrences over an image; blocks are opened when they are needed."""

    def __init__(self, data: bytes):
        self.data = memoryview(data)
        if self.data[:4] != MAGIC:
            raise ValueError("not a wavelet image")
        (size,) = struct.unpack_from("<I", self.data, 4)
        head, at = json.loads(bytes(self.data[8 : 8 + size])), 8 + size
        self.n, self.zeros, self.bits = head["n"], head["zeros"], head["bits"]
        self.levels, self.blocks = len(self.zeros), -(-self.n // self.bits)
        tables = []
        for length, crc in zip(head["sizes"], head["crc"]):
            tables.append(self._open(at, length, crc))
            at += length
        docs = pa.ipc.open_stream(tables[0]).read_all()
        self.doc_ids, self.lengths = docs["doc_id"].to_pylist(), docs["n"].to_numpy()
        directory, k = np.frombuffer(tables[1], "<i8"), self.levels * (self.blocks + 1)
        self.ones = directory[:k].reshape(self.levels, self.blocks + 1)
        self.place = directory[k : k + self.levels * self.blocks + 1] + at
        self.crc = directory[k + self.levels * self.blocks + 1 :]
        self.opened: dict[tuple[int, int], np.ndarray] = {}

    def _open(self, at: int, length: int, crc: int) -> bytes:
        blob = self.data[at : at + length]
        if zlib.crc32(blob) != crc:
            raise ValueError("damaged wavelet image")
        return zstandard.ZstdDecompressor().decompress(blob)

    def _block(self, level: int, k: int) -> np.ndarray:
        if (level, k) not in self.opened:
            i = level * self.blocks + k
            self.opened[level, k] = np.frombuffer(self._open(int(self.place[i]), int(self.place[i + 1] - self.place[i]), int(self.crc[i])), np.uint8)
        return self.opened[level, k]

    def _plane(self, level: int) -> np.ndarray:
        """The bits of a whole plane."""
        cut = [self._block(level, k) for k in range(self.blocks)]
        return np.unpackbits(np.concatenate(cut) if cut else np.zeros(0, np.uint8), count=self.n, bitorder="little").view(bool)

    def all(self) -> np.ndarray:
        """Every id in order, from the lowest plane back to the highest."""
        out = np.zeros(self.n, np.uint16 if self.levels <= 16 else np.uint32)
        for b in range(self.levels):
            bit, z = self._plane(self.levels - 1 - b), self.zeros[self.levels - 1 - b]
            up = np.empty_like(out)
            up[~bit] = out[:z]
            up[bit] = out[z:] | (1 << b)
            out = up
        return out

    def _rank1(self, level: int, i: int) -> int:
        k, rest = divmod(i, self.bits)
        if not rest:
            return int(self.ones[level, k])
        block = self._block(level, k)
        ones = int(np.bitwise_count(block[: rest >> 3]).sum(dtype=np.int64))
        if rest & 7:
            ones += (int(block[rest >> 3]) & ((1 << (rest & 7)) - 1)).bit_count()
        return int(self.ones[level, k]) + ones

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(self.levels):
            k, rest = divmod(i, self.bits)
            bit = int(self._block(level, k)[rest >> 3]) >> (rest & 7) & 1
            ones = self._rank1(level, i)
            value = value << 1 | bit
            i = self.zeros[level] + ones if bit else i - ones
        return value

    def _range(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        if token < 0 or token >> self.levels:
            return 0, 0
        for level in range(self.levels):
            if lo >= hi:
                return 0, 0
            a, b = self._rank1(level, lo), self._rank1(level, hi)
            one = token >> (self.levels - 1 - level) & 1
            lo, hi = (self.zeros[level] + a, self.zeros[level] + b) if one else (lo - a, hi - b)
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences of ``token`` in [lo, hi)."""
        a, b = self._range(token, lo, self.n if hi is None else hi)
        return b - a

    def select(self, token: int, k: int) -> int:
        """Place of the k-th occurrence (from 0) of ``token``; -1 if there are fewer."""
        lo, hi = self._range(token, 0, self.n)
        if not 0 <= k < hi - lo:
            return -1
        i = lo + k
        for level in range(self.levels - 1, -1, -1):
            one = token >> (self.levels - 1 - level) & 1
            i = self._select_bit(level, one, i - self.zeros[level] if one else i)
        return i

    def _select_bit(self, level: int, one: int, k: int) -> int:
        before = self.ones[level] if one else np.arange(self.blocks + 1) * self.bits - self.ones[level]
        block = int(np.searchsorted(before[: self.blocks], k, "right")) - 1
        bits = np.unpackbits(self._block(level, block), bitorder="little")
        return block * self.bits + int(np.flatnonzero(bits == one)[k - before[block]])

    def occurrences(self, token: int) -> np.ndarray:
        """All places of ``token``, in order."""
        lo, hi = self._range(token, 0, self.n)
        at = np.arange(lo, hi)
        for level in range(self.levels - 1, -1, -1):
            if not at.size:
                break
            bit = self._plane(level)
            at = np.flatnonzero(bit)[at - self.zeros[level]] if token >> (self.levels - 1 - level) & 1 else np.flatnonzero(~bit)[at]
        return at


_encoders: dict = {}
_TAIL = ".,!?;:#*$%&|"
_PROBES = ["The quick brown fox", "a  b", " a", "a ", "x\ny, z", "é 1 2.\n\n'tis it's", "ab cd. ef"]


def _byte_letters() -> list[str]:
    """The letter of each byte in byte-level vocabularies: printable bytes stand for themselves, others follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class _Cache(dict):
    """Bytes of stretches; ``miss`` makes and keeps what is asked for and not there."""

    __slots__ = ("miss",)

    def __missing__(self, w: str) -> bytes:
        return self.miss(w)


class _Encoder:
    """Ids of the tokenizers library, through a cache of stretches without spaces.

    Where a space ends every pre-token of the tokenizer, stretches between spaces are
    encoded apart and their ids joined; probes tell whether this holds, and texts of other
    tokenizers go to the library whole. In a text that is in normal form C before and
    after lower-casing, a stretch is cached in lower case, and letters apart from the
    punctuation that follows them; a pre-token of letters alone goes straight to the
    library's merge model. A text with a marker of special tokens, or a letter whose lower
    case depends on its place, takes none of these steps.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        self.t.no_truncation()
        self.t.no_padding()
        self.wide = np.dtype("<u2") if self.t.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.letters = _byte_letters()
        self.code = "H" if self.wide.itemsize == 2 else "I"
        self.cache = _Cache({"": b""})
        self.splits = all(self._library(p) == [i for w in p.replace("\n", " ").split(" ") for i in self._library(w)] for p in _PROBES)
        # the shortcut holds for a tokenizer that ignores case and parts letters from the rest
        self.folds = self.splits and self._library("Ab,") == self._model("ab") + self._library(",")

    def _library(self, text: str) -> list[int]:
        return self.t.encode(text, add_special_tokens=False).ids

    def _model(self, word: str) -> list[int]:
        if not word.isascii():
            word = "".join(map(self.letters.__getitem__, word.encode()))
        return [x.id for x in self.t.model.tokenize(word)]

    def _bytes(self, ids: list[int]) -> bytes:
        packed = array(self.code, ids)
        if sys.byteorder == "big":
            packed.byteswap()
        return packed.tobytes()

    def _put(self, w: str, x: bytes) -> bytes:
        if len(w) <= 64:
            if len(self.cache) >= WORKER_CACHE:
                self.cache.clear()
                self.cache[""] = b""
            self.cache[w] = x
        return x

    def _plain(self, w: str) -> bytes:
        x = self.cache.get(w)
        return self._put(w, self._bytes(self._library(w))) if x is None else x

    def _folded(self, w: str) -> bytes:
        core = w.rstrip(_TAIL)
        if not core.isalpha():
            return self._plain(w)
        x = self.cache.get(core)
        if x is None:
            x = self._put(core, self._bytes(self._model(core)))
            return x + self._plain(w[len(core) :]) if len(core) < len(w) else x
        x += self._plain(w[len(core) :])  # seen before: the stretch may come again too
        return self._put(w, x)

    def ids(self, text: str) -> bytes:
        if not self.splits:
            return self._bytes(self._library(text))
        self.cache.miss = self._plain
        if self.folds and "<|" not in text and "Σ" not in text:
            low = text.lower()
            if text.isascii() or unicodedata.is_normalized("NFC", text) and unicodedata.is_normalized("NFC", low):
                text, self.cache.miss = low, self._folded
        return b"".join(map(self.cache.__getitem__, text.replace("\n", " ").split(" ")))


def encoder(path: str) -> _Encoder:
    claim("wavelet", _encoders)
    if path not in _encoders:
        _encoders[path] = _Encoder(path)
    return _encoders[path]


IMAGE = T.StructType([
    T.StructField("shard", T.StringType()),
    T.StructField("part", T.IntegerType()),
    T.StructField("seq", T.IntegerType()),
    T.StructField("before", T.LongType()),
    T.StructField("n_docs", T.LongType()),
    T.StructField("n_tokens", T.LongType()),
    T.StructField("image", T.BinaryType()),
])


def encode_shards(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                  end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Range-partition documents by id and return one row per shard image.

    Null texts are empty and give the end id alone; null ids sort first; repeated ids
    keep one entry each, next to each other, ordered by text.
    """
    ensure_importable(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, enc, seq = TaskContext.get().partitionId(), encoder(tokenizer), 0
        end = np.array([end_id], enc.wide).tobytes()
        docs: list = []
        lengths: list[int] = []
        blobs: list[bytes] = []
        total = before = 0

        def flush():
            ids = np.frombuffer(b"".join(blobs), enc.wide)
            return pa.RecordBatch.from_pydict({
                "shard": [f"{part:06d}-{seq:06d}"], "part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()),
                "before": pa.array([before], pa.int64()), "n_docs": pa.array([len(docs)], pa.int64()), "n_tokens": pa.array([ids.size], pa.int64()),
                "image": pa.array([pack(docs, lengths, ids)], pa.binary()),
            })

        for b in batches:
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x = enc.ids(t) + end if t else end
                docs.append(d)
                lengths.append(len(x) // enc.wide.itemsize)
                blobs.append(x)
                total += lengths[-1]
                if total >= shard_tokens:
                    yield flush()
                    seq, before = seq + 1, before + total
                    docs, lengths, blobs, total = [], [], [], 0
        if docs:
            yield flush()

    n = parts(df.sparkSession)
    cols = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return cols.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(run, IMAGE)


def write_shards(df: DataFrame, tokenizer: str, path: str | None = None, **kw) -> DataFrame:
    """Write the shard images through Spark's committer and return the table read back. They
    stay at ``path``; without one, they last as long as the driver."""
    shards = encode_shards(df, tokenizer, **kw)
    if path is None:
        return materialize(shards, "wavelet")
    shards.write.parquet(path)
    return df.sparkSession.read.schema(IMAGE).parquet(path)


def read_tokens(shards: DataFrame) -> DataFrame:
    """Per document of the images: start, n_tokens and the checksum of its decoded ids."""
    ensure_importable(shards.sparkSession)
    at, starts = 0, []
    for r in shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect():  # a row per partition of the write
        starts.append((r.part, at))
        at += r.n
    offsets = shards.sparkSession.createDataFrame(starts, "part int, at long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for base, data in zip(b.column(0).to_pylist(), b.column(1)):
                image = Image(data.as_buffer())
                docs, lengths, ids = image.doc_ids, image.lengths, image.all().astype("<u4")
                ends = np.cumsum(lengths)
                view = memoryview(ids).cast("B") if ids.size else memoryview(b"")
                crc = [zlib.crc32(view[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist())]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(docs, pa.int64()), "start": pa.array(ends - lengths + base, pa.int64()),
                    "n_tokens": pa.array(lengths, pa.int64()), "ids_crc32": pa.array(crc, pa.int64()),
                })

    return (
        shards.select("part", "before", "image").join(F.broadcast(offsets), "part")
        .select((F.col("at") + F.col("before")).alias("base"), "image").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
    )


def find_tokens(shards: DataFrame, tokens: list[int]) -> DataFrame:
    """Where ``tokens`` occur, looked up in the images: doc_id, token and place in the document.

    Only the planes' blocks are opened, no text and no id sequence. Tokens that occur
    nowhere give no row.
    """
    ensure_importable(shards.sparkSession)
    wanted = sorted(set(tokens))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0):
                image = Image(data.as_buffer())
                ends = np.cumsum(image.lengths)
                for token in wanted:
                    at = image.occurrences(token)
                    doc = np.searchsorted(ends, at, "right")
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array([image.doc_ids[d] for d in doc], pa.int64()), "token": pa.array(np.full(len(at), token), pa.int64()),
                        "place": pa.array(at - (ends - image.lengths)[doc], pa.int64()),
                    })

    return shards.select("image").mapInArrow(run, "doc_id long, token long, place long")


def count_tokens(shards: DataFrame, tokens: list[int]) -> DataFrame:
    """Occurrences of each of ``tokens`` in all images: token, n. Opens two blocks of a plane."""
    ensure_importable(shards.sparkSession)
    wanted = sorted(set(tokens))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0):
                image = Image(data.as_buffer())
                yield pa.RecordBatch.from_pydict({"token": pa.array(wanted, pa.int64()), "n": pa.array([image.count(t) for t in wanted], pa.int64())})

    return shards.select("image").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
