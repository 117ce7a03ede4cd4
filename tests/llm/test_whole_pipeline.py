"""Every stage of the pipeline against a plain version of it, over whole tables; packing of rows that repeat exactly."""

import collections
import math
import os
import struct
import sys
import zlib
from bisect import bisect_left, insort

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from mixlens.llm import common, op2_packing, op9_langid, oracles, stages

sys.path.insert(0, os.path.dirname(__file__))
from test_corpus_operators import brute_spans, shingles  # noqa: E402

ROOT = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def outputs(spark):
    """What goes into and comes out of each stage."""
    docs, out = common.table(spark, ROOT, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        made = common.materialize(stage(spark, docs, ROOT), name)
        out.append((docs, made))
        docs = made
    return dict(zip([n for n, _ in corpus_pipeline.STAGES], out, strict=True))


def rows_of(df):
    return sorted(tuple(r) for r in df.select(*corpus_pipeline.COLUMNS).collect())


def test_quality(outputs):
    docs, made = outputs["quality"]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{ROOT}/documents.parquet')")
    kept = {r[0] for r in con.execute(f"SELECT doc_id FROM ({oracles.quality()}) WHERE kept").fetchall()}
    assert rows_of(made) == [r for r in rows_of(docs) if r[0] in kept] and 0 < len(kept) < docs.count()


def flat(found):
    return "".join(chr(c) if c else " " for c in found)


def longest_matches(known, text):
    n = i = 0
    while i < len(text):
        j = i + 1
        while j <= len(text) and text[i:j] in known:
            j += 1
        n, i = n + 1, max(i + 1, j - 1)
    return n


def test_language(outputs):
    docs, made = outputs["language"]
    samples = {x: flat(s) for x, s in op9_langid.sample(op9_langid.labelled(docs), 24_000, 256).items()}
    assert len(samples) == 4
    want = []
    for doc_id, text, lang, source, n_chars in rows_of(docs):
        letters = flat(op9_langid.letters(text))
        cost = sorted((longest_matches(s, letters) * math.log2(len(s)), x) for x, s in samples.items())
        if letters.strip() and 1 - cost[0][0] / cost[1][0] >= stages.LEAST_SCORE:
            want.append((doc_id, text, lang or cost[0][1], source, n_chars))
    assert rows_of(made) == want and len(want) > 20


def test_near_duplicates(outputs):
    docs, made = outputs["near_duplicates"]
    rows = rows_of(docs)
    sets = {r[0]: shingles(r[1], 5) for r in rows}
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    assert len(ids) == len(rows)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    want = [r for r in rows if find(r[0]) == r[0]]
    assert rows_of(made) == want and len(want) < len(rows)


def test_repeated_passages(outputs):
    docs, made = outputs["repeated_passages"]
    rows = rows_of(docs)
    left = {k: text for k, (text, _) in brute_spans([r[:2] for r in rows]).items() if text.strip(" ")}
    assert rows_of(made) == [(k, left[k], lang, source, len(left[k])) for k, _, lang, source, _ in rows if k in left]
    assert any(left.get(r[0]) != r[1] for r in rows)


def plain_best_fit(lengths, capacity=1024):
    """Number of sequences of best-fit decreasing."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        k = bisect_left(rooms, n)
        room = rooms.pop(k) if k < len(rooms) else capacity
        insort(rooms, room - n)
    return len(rooms)


def whole_and_gapless(rows):
    """The sequences that hold these pieces, each filled from 0 without a gap."""
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    return len(sequences)


def test_packing(outputs):
    from tokenizers import Tokenizer

    docs, made = outputs["packing"]
    lib, rows = Tokenizer.from_file(common.tokenizer_path("byte_bpe_50k.json")), made.collect()
    by_doc = collections.defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
    texts = {r[0]: r[1] for r in rows_of(docs)}
    assert set(by_doc) == set(texts)
    for k, text in texts.items():
        ids, at = [*lib.encode(text or "", add_special_tokens=False).ids, 2], 0
        for n, r in enumerate(sorted(by_doc[k], key=lambda r: r["piece"])):
            own = ids[at : at + r["length"]]
            assert (r["piece"], r["start"], r["ids_crc32"]) == (n, at, zlib.crc32(struct.pack(f"<{len(own)}I", *own)))
            assert n == 0 or r["length"] == 1024
            at += r["length"]
        assert at == len(ids) and len(by_doc[k]) == -(-len(ids) // 1024)
    assert -(-sum(r["length"] for r in rows) // 1024) <= whole_and_gapless(rows) <= plain_best_fit([r["length"] for r in rows])


def test_packing_of_rows_that_repeat_exactly(spark):
    rows = [(7, 0, 0, 300, 11)] * 900 + [(None, 0, 0, 124, 5)] * 250 + [(k, 0, 0, 1 + k % 1024, k) for k in range(60)]
    pieces = common.materialize(spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long").repartition(5), "copies")
    got = op2_packing.pack(pieces).collect()
    assert collections.Counter(tuple(r)[:5] for r in got) == collections.Counter(rows)
    assert len({(r["sequence_id"], r["offset"]) for r in got}) == len(rows)
    assert whole_and_gapless(got) <= plain_best_fit([r[3] for r in rows])
    buckets = pieces.select(F.pmod(F.xxhash64("_metadata.file_name", "_metadata.row_index"), F.lit(4)).alias("b"), "doc_id").where("doc_id = 7")
    assert all(150 < r["count"] < 300 for r in buckets.groupBy("b").count().collect())
