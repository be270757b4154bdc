import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from spindrift.llm import queries, token_counts, wavelet

ODD = [None, "", " ", "  a", "a  b", "a \nb", "\na", "a\n\nb c", "x\ty", "<s> x </s>", "a▁b", "é é ﬁ ａ",
       "don't <|endoftext|> It's", "日本語 テキスト", "a" * 5000, "w " * 20000, "　x\x85y\x1cz", "Σας ΣΑΣ"]
SCHEMA = "doc_id long, text string, n_tokens long, extra string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, 7, None) for i, t in enumerate(ODD)] + [(3, "  a", 7, None)], SCHEMA).drop("n_tokens")


def test_counts_equal_the_library(spark, odd, sf_dir):
    m = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=m)
    for df in (odd, spark.read.parquet(f"{sf_dir}/documents.parquet")):
        for size, docs in ((50_000, 10_000), (3, 40)):
            for r in token_counts.count_tokens(df, m, hot_size=size, sample_docs=docs).collect():
                assert r.n_tokens == len(sp.encode(r.text or "")), r.text
    assert token_counts.count_tokens(odd.limit(0), m).count() == 0
    assert token_counts.counter(m).decomposes


def test_op7(spark, sf_dir):
    df = queries.op7_token_counts(spark, sf_dir)
    assert df.columns[:4] == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert df.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()


def expected(rows):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    at, out = 0, []
    for d, text in sorted(rows, key=lambda r: (r[0], r[1] or "")):
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_op6_round_trip(spark, odd, sf_dir):
    got = [tuple(r) for r in queries.op6_wavelet_tokens(spark, sf_dir).collect()]
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert sorted(got) == expected(rows)
    path = public_tokenizers.path("word_bpe_49k.json")
    shards = wavelet.write_shards(odd, path, shard_tokens=5)
    assert sorted(tuple(r) for r in wavelet.read_tokens(shards).collect()) == expected([(r.doc_id, r.text) for r in odd.collect()])
    assert wavelet.read_tokens(wavelet.write_shards(odd.limit(0), path)).count() == 0


def test_wavelet_access_rank_select(monkeypatch):
    rng = np.random.default_rng(3)
    for bits in (64, 1 << 18):
        monkeypatch.setattr(wavelet, "BLOCK_BITS", bits)
        for n, top in ((0, 5), (1, 1), (3000, 70000), (1025, 40), (128, 3)):
            ids = rng.integers(0, top, n)
            data = wavelet.pack([1], [n], ids.astype("<u4"))
            assert wavelet.Image(data).all().tolist() == ids.tolist()
            for i in range(0, n, 97):
                assert wavelet.Image(data).access(i) == ids[i]
            im = wavelet.Image(data)
            for tok in set(ids[:20].tolist()) | {top + 5, 1 << 20}:
                where = np.flatnonzero(ids == tok).tolist()
                assert im.occurrences(tok).tolist() == where
                assert [im.select(tok, k) for k in range(len(where) + 1)] == [*where, -1]
                assert im.count(tok, n // 3, n // 2) == sum(n // 3 <= w < n // 2 for w in where)
    im = wavelet.Image(wavelet.pack([1], [10**6], rng.integers(0, 30, 10**6).astype("<u4")))
    assert im.count(7) > 0 and len(im.opened) <= 2 * im.levels < im.levels * im.blocks
    with pytest.raises(ValueError):
        wavelet.Image(b"none" + data[4:])
    with pytest.raises(ValueError):
        wavelet.Image(data[:-1] + bytes([data[-1] ^ 1])).all()


def test_lookups_in_written_images(spark, odd, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    wavelet.write_shards(odd, path, f"file://{tmp_path}/images", shard_tokens=50)
    shards = spark.read.parquet(f"file://{tmp_path}/images")
    ids = [(r.doc_id, t.encode(r.text or "", add_special_tokens=False).ids + [2]) for r in odd.collect()]
    asked = [2, ids[3][1][0], t.encode("w", add_special_tokens=False).ids[0], 49000]
    want = sorted((d, k, i) for d, x in ids for i, k in enumerate(x) if k in asked)
    assert sorted(tuple(r) for r in wavelet.find_tokens(shards, asked).collect()) == want
    assert {r.token: r.n for r in wavelet.count_tokens(shards, asked).collect()} == {k: sum(w[1] == k for w in want) for k in asked}


def test_other_tokenizers_encode_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    enc, t = wavelet.encoder(path), Tokenizer.from_file(path)
    assert not enc.splits and wavelet.encoder(public_tokenizers.path("word_bpe_49k.json")).folds
    for text in ("The quick brown fox", "a\n\nb  c", "é 日本"):
        assert np.frombuffer(enc.ids(text), enc.wide).tolist() == t.encode(text, add_special_tokens=False).ids
