"""Ids against the library that reads the same ranks."""

import base64
import hashlib

import numpy as np
import public_tokenizers
import tiktoken

from netsluice.llm import byte_bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TEXTS = [
    "", "a", " ", "Hello world, it's 2024!", "Größe über alles — naïve façade", "日本語のテキスト 中文 한국어", "x" * 3000, "ab" * 700,
    "\n\n\t  \r\n  end ", "😀😀 emoji 👩‍👩‍👧 zwj", "<|endoftext|>", "\x00\x01\x02", " " * 500, "ñandú " * 200, "aaaaabaaaaab",
]


def want(texts):
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return [own.encode_ordinary(t or "") for t in texts]


def test_round_trip(spark):
    rows = list(enumerate(TEXTS)) + [(100, None), (None, "no id"), (3, TEXTS[3])]
    df = spark.createDataFrame([(i, t, 1, "z") for i, t in rows], "doc_id long, text string, ids int, n_tokens string")
    got = sorted((tuple(r) for r in byte_bpe.round_trip_digests(df, PATH, public_tokenizers.PATTERN).collect()), key=str)
    expected = []
    for (i, t), ids in zip(rows, want([t for _, t in rows])):
        raw = np.array(ids, "<u4").tobytes()
        expected.append((i, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(expected, key=str)
    ids = byte_bpe.encoded(df, PATH, public_tokenizers.PATTERN)
    back = sorted(bytes(r.raw) for r in byte_bpe.decoded(ids, PATH, public_tokenizers.PATTERN).collect())
    assert back == sorted((t or "").encode() for _, t in rows)


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert byte_bpe.round_trip_digests(empty, PATH, public_tokenizers.PATTERN).collect() == []


def test_leftmost_pair_of_least_rank():
    ranks = {bytes([b]): b for b in range(256)} | {b"aa": 256, b"ab": 257, b"aab": 258, b"ba": 259}
    bpe = byte_bpe.ByteBpe(ranks, r"[ab]+")
    assert np.frombuffer(bpe.encode(["aaaab"])[0], "<u4").tolist() == [256, 258]
    assert np.frombuffer(bpe.encode(["abab"])[0], "<u4").tolist() == [257, 257]
