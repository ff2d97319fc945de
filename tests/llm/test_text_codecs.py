"""Byte-level BPE and media columns: exact round trips, brute force, damage."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("tidewheel.llm")
from tidewheel.llm import byte_bpe, png_media, queries  # noqa: E402

EDGES = [(1, "Hello  world'll 'tis\n\n x"), (2, ""), (3, None), (None, "no id"), (3, "Hello"), (3, "Hello"), (4, "é中𝄞 " * 50), (5, "a" * 3000 + " " * 500), (6, "\u0000﻿ 　x")]


@pytest.fixture(scope="module")
def encoding():
    import public_tokenizers
    import tiktoken

    v = byte_bpe.Vocabulary(byte_bpe.read_ranks(queries.rank_file()))
    return v, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=v.ranks, special_tokens={})


def reference(enc, text):
    return np.array(enc.encode_ordinary(text), "<u4").tobytes()


def test_every_code_point_and_random_mixes(encoding):
    v, enc = encoding
    texts = [f"a{chr(c)}b 1{chr(c)} {chr(c)}{chr(c)} x" for c in range(0, 0x110000, 7) if not 0xD800 <= c < 0xE000]
    r = random.Random(1)
    parts = ["'", "s", "re", "ve", "ll", "l", "e", " ", "  ", "\n", "\t", "12", "!", "é", "Z", "中", "'s"]
    texts += ["".join(r.choice(parts) for _ in range(r.randint(0, 30))) for _ in range(4000)]
    ids, ends = v.encode(texts)
    assert [reference(enc, t) for t in texts] == ids
    assert all(v.decode(a, b) == t.encode() for t, a, b in zip(texts, ids, ends, strict=True))


def test_long_slices_merge_alike(encoding):
    v, enc = encoding
    r = random.Random(2)
    texts = ["x" * 64, "x" * 65, "".join(r.choice("abcé") for _ in range(900)), "ab" * 32]
    assert v.encode(texts)[0] == [reference(enc, t) for t in texts]


def test_the_scan_of_functions_equals_the_automaton():
    r = np.random.default_rng(3)
    kinds = r.integers(0, 10, 2000).astype(np.uint8)
    first = np.array([0, 5, 700, 1999])
    state, want = 0, []
    for i, k in enumerate(kinds):
        state = byte_bpe.step(0 if i in first else state, int(k))
        want.append(state)
    assert byte_bpe.scan_states(kinds, first).tolist() == want


def test_encode_edges(spark, encoding):
    _, enc = encoding
    df = spark.createDataFrame(EDGES, "doc_id int, text string").withColumn("ids", F.lit("clash")).withColumn("n_tokens", F.lit(7))
    got = byte_bpe.encode(df, queries.rank_file())
    back = byte_bpe.decode(got, queries.rank_file(), keep=("doc_id", "ids"))
    want = sorted((str(i), reference(enc, t or ""), (t or "").encode()) for i, t in EDGES)
    assert sorted((str(x.doc_id), bytes(x.ids), bytes(x.decoded)) for x in back.collect()) == want
    assert byte_bpe.encode(df.limit(0), queries.rank_file()).count() == 0


def test_media_round_trip(spark):
    df = spark.createDataFrame(EDGES, "doc_id int, text string").withColumn("media", F.lit("clash"))
    out = png_media.load(png_media.store(df), keep=("doc_id", "n_bytes", "media"), payload=True).collect()
    for x in out:
        raw = bytes(x.payload)
        assert len(raw) % 64 == 0 and len(raw) >= 64 and len(raw) - x.n_bytes <= 64
    assert sorted(bytes(x.payload).rstrip(b"\0") for x in out) == sorted((t or "").encode().rstrip(b"\0") for _, t in EDGES)
    twice = [x for x in out if x.doc_id == 3 and x.n_bytes == 5]
    assert len({(x.feature, bytes(x.media)) for x in twice}) == 1 and len(twice) == 2


def test_media_files_are_checked():
    data = png_media.encode_png(np.arange(128, dtype=np.uint8).reshape(2, 64))
    assert (png_media.decode_png(data).ravel() == np.arange(128)).all()
    for i in (3, 20, 45, len(data) - 2):
        with pytest.raises((ValueError, zlib.error)):
            png_media.decode_png(data[:i] + bytes([data[i] ^ 1]) + data[i + 1 :])
    with pytest.raises(ValueError):
        png_media.decode_png(data[:-5])


def test_all_row_filters():
    r = np.random.default_rng(4)
    for n in (1, 3):
        want = r.integers(0, 256, (12, 8 * n)).astype(int)
        kinds = r.integers(0, 5, 12).astype(np.uint8)
        rows = np.zeros_like(want)
        for y in range(12):
            for x in range(8 * n):
                a = want[y, x - n] if x >= n else 0
                b = want[y - 1, x] if y else 0
                c = want[y - 1, x - n] if y and x >= n else 0
                p = a + b - c
                near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                rows[y, x] = want[y, x] - [0, a, b, (a + b) // 2, near][kinds[y]]
        assert (png_media.unfilter(kinds, (rows % 256).astype(np.uint8), n) == want).all()


def test_digest_queries(spark, sf):
    docs = {x.doc_id: x.text for x in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for x in queries.op3_byte_bpe(spark, sf).collect():
        assert x.decoded_sha256 == hashlib.sha256(docs[x.doc_id].encode()).hexdigest()
    for x in queries.op5_png_media(spark, sf).collect():
        raw = docs[x.doc_id].encode()
        padded = raw.ljust(max(1, -(-len(raw) // 64)) * 64, b"\0")
        assert (x.payload_bytes, x.payload_sha256, x.tail_crc32) == (len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
