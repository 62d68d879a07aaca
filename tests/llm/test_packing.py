"""Pieces against the tokenizer itself, sequences against what makes them valid."""

import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from netsluice.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "it's don't I'LL, ΣΑΣ Σ İstanbul ﬁ ŉ x́y é, é. a b c 1,2.3 ½ ２３ ª º ǅ 한글 각 <|endoftext|> <|startoftext|>x", "ˋ ʰ ⅷ Ⅷ ㎏ ff.,.. x., .a ,",
    "\x1c a\x1db\x85c", "", "word " * 9000, "x" * 5000, "the and of", "the and of",
]


def pieces(rows, capacity):
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    out = []
    for i, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), capacity):
            part = ids[k : k + capacity]
            out.append((i, k // capacity, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    return sorted(out, key=str)


def filled(rows, capacity):
    """Number of sequences, after a look at their gapless filling."""
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


def test_pieces(spark):
    r = random.Random(1)
    rows = list(enumerate(TEXTS)) + [(100, None), (None, "no id"), (2, TEXTS[2])]
    rows += [(1000 + k, " ".join(r.choice(["the", "of", "zebra,"]) for _ in range(r.randint(0, 300)))) for k in range(150)]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, task int, length int").repartition(5)
    for capacity in (4096, 64):
        got = packing.pack(df, PATH, capacity).collect()
        assert sorted(((x.doc_id, x.piece, x.start, x.length, x.ids_crc32) for x in got), key=str) == pieces(rows, capacity)
        used = filled(got, capacity)
        assert used <= 1.02 * -(-sum(x.length for x in got) // capacity) + 1


def test_added_tokens(spark, tmp_path):
    """The query op6 and the pipeline's stage give the ids of the tokenizer's plain call."""
    import corpus_pipeline
    from netsluice.llm import queries

    t = Tokenizer.from_file(PATH)
    texts = TEXTS + [
        "see <|endoftext|> here", "x<|endoftext|>,y <|ENDOFTEXT|> <|StartOfText|> <|startoftext|><|endoftext|>", "<|endoftext|>",
        "don<|endoftext|>'t a <|endoftext|>. b.<|endoftext|> e<|endoftext|>\u0301 <|endoftext| <<|endoftext|>>", " <|startoftext|>\n",
    ]
    want = []
    for i, text in enumerate(texts):
        ids = t.encode(text, add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), 4096):
            part = ids[k : k + 4096]
            want.append((i, k // 4096, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for out in (queries.op6(spark, str(tmp_path)), corpus_pipeline.best_fit_packing(spark, docs, str(tmp_path))):
        assert sorted((x.doc_id, x.piece, x.start, x.length, x.ids_crc32) for x in out.collect()) == want


def test_empty(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


def test_rounds_place_all():
    r = random.Random(2)
    for _ in range(30):
        capacity = r.choice([1, 7, 50, 300])
        counts = {r.randint(1, capacity): r.choice([0, 1, 5, 100_000]) for _ in range(r.randint(0, 40))}
        runs = packing.match_rounds(counts, capacity)
        for size, n in counts.items():
            own = sorted(x[1:3] for x in runs if x[0] == size)
            assert sum(x[1] for x in own) == n and all(a[0] + a[1] == b[0] for a, b in zip(own, own[1:]))
        sequences = max((x[3] + x[2] for x in runs), default=0)
        total = sum(s * n for s, n in counts.items())
        assert sequences >= -(-total // capacity) and sequences * capacity <= 2 * total + capacity


def test_no_better_than_the_bound_with_halves():
    assert max(x[3] + x[2] for x in packing.match_rounds({51: 10, 49: 10}, 100)) == 10
