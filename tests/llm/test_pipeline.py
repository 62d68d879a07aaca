"""Each stage of the pipeline against a brute-force version over its own input."""

import random

import corpus_pipeline
import test_bag_minhash
import test_line_join
import test_suffix_dedup
from test_packing import filled, pieces

from netsluice.llm import line_quality
from netsluice.llm.common import written


def corpus(seed=8):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefghiklmnoprstu") for _ in range(r.randint(2, 8))) for _ in range(900)]
    line = lambda n=14: " ".join(r.choice(words) for _ in range(n)).capitalize() + "."
    common, passage = line(9), " ".join(r.choice(words) for _ in range(60))
    docs, labels = [], []
    for i in range(40):
        lines = [line() for _ in range(r.randint(5, 9))]
        if i % 4 == 0:
            lines.insert(2, common)
        if i % 5 == 0:
            lines.append(f"{line(3)} {passage} {line(3)}")
        docs.append("\n".join(lines))
        labels.append(1)
    for i in range(14):
        docs.append("\n".join(" | ".join(r.choice(words) for _ in range(12)) + " |" for _ in range(7)))
        labels.append(0)
    base = docs[1].split("\n")
    near = [x.replace(" ", " q ", 1) if k % 3 == 0 else x for k, x in enumerate(base)]
    docs += [docs[2], docs[2], "\n".join(near), "few words", "", None]
    labels += [None] * 6
    rows = [(i, d, "en", f"s{i % 3}", len(d or "")) for i, d in enumerate(docs)]
    return rows, [(i, q, 0) for i, q in enumerate(labels) if q is not None and i % 7]


def sequence(rows):
    return sorted(((r.doc_id, r.text) for r in rows), key=str)


def test_stages(spark, tmp_path):
    rows, labels = corpus()
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, columns).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        given = sequence(docs.collect())
        out = written(stage(spark, docs, str(tmp_path)), "test-stage")
        seen.append((given, out, docs))
        if name != "best-fit packing":
            assert out.columns == docs.columns
            by_id = {r[0]: r for r in rows}
            assert all((r.lang, r.source, r.n_chars) == by_id[r.doc_id][2:] for r in out.collect())
        docs = out

    given, out, table = seen[0]
    field = line_quality.train(table, spark.read.parquet(str(tmp_path / "labels.parquet")))
    verdicts = line_quality._verdicts([t or "" for _, t in given], field, line_quality.CONTENT_SHARE)
    assert sequence(out.collect()) == [g for g, kept in zip(given, verdicts) if kept]
    assert {i for i, _ in sequence(out.collect())} == set(range(40)) | {54, 55, 56}

    given, out, _ = seen[1]
    kept = {(d, k) for d, k, _, _, _, _, first in test_line_join.brute(given) if first}
    want = []
    for d, t in given:
        lines = [x for k, x in enumerate(t.split("\n")) if not x.strip() or (d, k) in kept]
        if any(x.strip() for x in lines):
            want.append((d, "\n".join(lines)))
    assert sequence(out.collect()) == sorted(want, key=str)
    assert not {54, 55} & {d for d, _ in want}  # exact copies have no line left

    given, out, _ = seen[2]
    keep = {d for d, _, first in test_bag_minhash.brute(given) if first}
    assert sequence(out.collect()) == [g for g in given if g[0] in keep]

    given, out, _ = seen[3]
    removed = {d: gone for d, _, gone, _, _ in test_suffix_dedup.brute(given, 100)}
    got = dict(sequence(out.collect()))
    assert sum(removed.values()) > 0
    for d, t in given:
        assert len(t.encode()) - len(got[d].encode()) == removed[d] and (removed[d] or got[d] == t)

    given, out, _ = seen[4]
    packed = out.collect()
    assert sorted(((x.doc_id, x.piece, x.start, x.length, x.ids_crc32) for x in packed), key=str) == pieces(given, 4096)
    assert filled(packed, 4096) == -(-sum(x.length for x in packed) // 4096)
    again = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(map(str, (x[:5] for x in again))) == sorted(map(str, (x[:5] for x in packed)))
