"""Conversation trie, personal data and hot-key join against brute force, odd rows included."""

import collections
import hashlib
import random
import re
import zlib

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mixlens.llm import op11_trie, op12_pii, op13_hotjoin, registry

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_luhn(number):
    doubled = [int(d) * (1 + k % 2) for k, d in enumerate(number[::-1])]
    return sum(x // 10 + x % 10 for x in doubled) % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False, "card": 16 <= len(digits) <= 19 and plain_luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if good:
                out.append((kind, *m.span()))
    return out


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="01459.+-@ ()ab_%\né", max_size=60))
def test_base_spans(text):
    assert [s[:3] for s in op12_pii.find(text) if s.kind in op12_pii.BASE] == base_spans(text)


def test_base_spans_of_documents(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = registry.queries()["op12_pii"](spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(texts)
    for r in got:
        want = base_spans(texts[r["doc_id"]])
        told = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r["base_sha256"] == hashlib.sha256(told.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in op12_pii.BASE] == [sum(s[0] == k for s in want) for k in op12_pii.BASE]
        assert r["spans"].startswith(told) and all(x.split(":")[0] in op12_pii.ADDED for x in r["spans"][len(told) :].split(",") if x)


def kinds(text):
    return [(s.kind, text[s.start : s.end]) for s in op12_pii.find(text)]


def test_added_spans():
    assert kinds("Pay to GB82 WEST 1234 5698 7654 32 today") == [("iban", "GB82 WEST 1234 5698 7654 32")]
    assert kinds("IBAN DE89370400440532013000.") == [("iban", "DE89370400440532013000")]
    assert kinds("IBAN DE88370400440532013000.") == []  # check digits
    assert kinds("Order DE89370400440532013000.") == [("iban", "DE89370400440532013000")]  # the checksum outweighs the word
    assert kinds("My visa is 378282246310005, thanks") == [("short_card", "378282246310005")]
    assert kinds("Number 378282246310005, thanks") == []  # no word of cards nearby
    assert kinds("Visa 378282246310006") == []  # Luhn
    assert kinds("call me: (030) 555 1234") == [("local_phone", "(030) 555 1234")]
    assert kinds("Telefon: 089/5551234 oder so") == [] and kinds("Telefon: 089/555 1234") == [("local_phone", "089/555 1234")]
    assert kinds("the sum of 030 555 1234 is due") == []
    assert kinds("phone of order 030 555 1234") == []  # an order's number
    assert kinds("tel +1 (017) 555-7713.") == [("phone", "+1 (017) 555-7713")]  # within a base span nothing is added
    assert op12_pii.find("x@y.de, my email")[0].score > op12_pii.find("x@y.de")[0].score
    assert kinds("") == [] and op12_pii.find(None) == []


def test_long_texts_are_linear():
    for text in ("a" * 2_000_000, "1" * 2_000_000, "1 " * 1_000_000, "1." * 1_000_000, "@" * 1_000_000, "a@a." * 300_000, "+1" * 700_000, "AB12" * 500_000, "12-" * 600_000, "(" * 1_000_000):
        op12_pii.find(text)


def test_pii_of_odd_rows(spark):
    rows = [(1, None, 5), (2, "", 5), (None, "a@b.de", 5), (3, "a@b.de and a@b.de", 5), (3, "a@b.de and a@b.de", 5), (4, "é😀 1.2.3.4", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans long")
    got = sorted((r["doc_id"] or -1, [(s["kind"], s["start"], s["value"]) for s in r["spans"]]) for r in op12_pii.spans(df).collect())
    twice = [("email", 0, "a@b.de"), ("email", 11, "a@b.de")]
    assert got == [(-1, [("email", 0, "a@b.de")]), (1, []), (2, []), (3, twice), (3, twice), (4, [("ip", 3, "1.2.3.4")])]
    assert op12_pii.spans(df.limit(0)).collect() == []
    assert sorted((r["text"] or "", r["doc_id"] or 0) for r in op12_pii.masked(df).collect())[-1] == ("é😀 [IP]", 4)


def rebuilt(rows):
    """Rebuilt conversations of (conv, turn, role, text) rows."""
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            mark = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[c].append((turn is not None, turn or 0, mark, (role, text)))
    own = {c: [x[3] for x in sorted(v)] for c, v in own.items()}
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + own[c][h:]
    return out


def plain_trie(convs):
    nodes = collections.defaultdict(list)
    for c, path in convs.items():
        for d in range(len(path) + 1):
            nodes[tuple(path[:d])].append(c)
    kids = collections.Counter(p[:-1] for p in nodes if p)
    out = []
    for p, members in nodes.items():
        below = [q for q in nodes if q[: len(p)] == p]
        ends = ",".join(map(str, sorted(c for c in members if len(convs[c]) == len(p))))
        saved = sum((len(nodes[q]) - 1) * len(q[-1][1]) for q in below if q)
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), kids[p], sum(kids[q] == 0 for q in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def conversations(seed=3):
    own, rows = random.Random(seed), []
    starts = [("user", "Hi"), ("user", "Hello 😀"), (None, None), ("system", "")]
    for c in [*range(180), *range(300, 340), 512, 9_000_000_001]:
        path = [own.choice(starts)] * own.randint(0, 2) + [own.choice(starts) if own.random() < 0.6 else ("user", f"own {own.randint(0, 9)}") for _ in range(own.randint(1, 9))]
        if c in (100, 301, 302):
            path = path * 9  # deep ones
        rows += [(c, None if k == 0 and c % 7 == 0 else k, *t) for k, t in enumerate(path)]
    rows += [(20, 1, "user", "Hi"), (20, 1, "user", "Hi"), (None, 0, "user", "lost"), (None, None, None, None)]
    own.shuffle(rows)
    return rows


def plain_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def trie_rows(spark, rows):
    df = spark.createDataFrame([(*r, 7) for r in rows], "conv_id long, turn long, role string, text string, key long")
    nodes, ends = op11_trie.trie(op11_trie.rebuilt(op11_trie.turns(df)))
    hashes = nodes.join(op11_trie.ends_hashes(ends), "key", "left").withColumn("x", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)))
    return plain_rows(hashes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "x"))


def test_trie_against_brute_force(spark, monkeypatch):
    rows = conversations()
    want = plain_trie(rebuilt(rows))
    assert trie_rows(spark, rows) == want
    monkeypatch.setattr(op11_trie, "NODES", 5)  # many partial tries, ranges of a few ids
    monkeypatch.setattr(op11_trie, "RANGE", 3)
    monkeypatch.setattr(op13_hotjoin, "pieces", lambda spark: 40)
    assert trie_rows(spark, rows) == want


def test_a_long_conversation_is_handed_on_in_parts(monkeypatch):
    monkeypatch.setattr(op11_trie, "NODES", 50)
    own = random.Random(2)
    marks = [bytes([own.randrange(256)]) * 16 for _ in range(3000)]
    rows = [(5, 0, None, None, 0), *((5, 1, m, 1, 0) for m in marks), (6, 0, None, None, 0), *((6, 1, m, 1, 0) for m in marks[:10])]
    fields = [pa.int64(), pa.int8(), pa.binary(), pa.int64(), pa.int32()]
    batches = [pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 700], strict=True), fields, strict=True)], ["conv_id", "part", "turn", "chars", "skip"]) for k in range(0, len(rows), 700)]
    parts = list(op11_trie.local_tries(batches))
    assert max(p.num_rows for p in parts) <= 51 and len(parts) > 50
    counts, depths = collections.Counter(), {}
    for r in (r for p in parts for r in p.to_pylist() if r["bucket"] is None):
        counts[r["key"]] += r["n_convs"]
        depths[r["key"]] = r["depth"]
    by_depth = {d: k for k, d in depths.items()}
    assert sorted(depths.values()) == list(range(3001))
    assert all(counts[by_depth[d]] == 1 + (d <= 10) for d in range(3001))
    for r in (r for p in parts for r in p.to_pylist() if r["bucket"] is None):
        assert r["up"] == [by_depth[r["depth"] - (1 << k)] for k in range(r["depth"].bit_length())]
    assert sorted(r["ids"] for p in parts for r in p.to_pylist() if r["bucket"] is not None) == [[5], [6]]


def test_trie_of_nothing_and_of_plain_paths(spark):
    assert trie_rows(spark, []) == []
    df = spark.createDataFrame([(1, 0, "u", "a"), (2, 0, "u", "a"), (2, 1, "v", "b")], "conv_id long, turn long, role string, text string")
    nodes, ends = op11_trie.trie(op11_trie.paths(op11_trie.turns(df)))
    got = sorted((r["depth"], r["n_convs"], r["n_leaves"], r["saved_tokens"]) for r in nodes.collect())
    assert got == [(0, 2, 1, 1), (1, 2, 1, 1), (2, 1, 1, 0)]
    assert sorted((r["ids"]) for r in ends.collect()) == [[1], [2]]


def test_merging_again_changes_nothing(spark):
    df = spark.createDataFrame(conversations(5), "conv_id long, turn long, role string, text string")
    known = op11_trie.paths(op11_trie.turns(df)).coalesce(1).sortWithinPartitions("conv_id", "part", F.asc_nulls_first("at"), "turn")
    part = known.select("conv_id", "part", "turn", "chars", "skip").mapInArrow(op11_trie.local_tries, op11_trie._PARTIAL)
    once = op11_trie.merge(part.where("bucket IS NULL"))
    rows = sorted(tuple(r) for r in once.collect())
    assert sorted(tuple(r) for r in op11_trie.merge(once).collect()) == rows


def sides():
    own = random.Random(8)
    left = [(own.choice([None, 1, 1, 1, 2, own.randint(3, 60), own.randint(100, 160)]), k % 150, f"l{k}") for k in range(300)]
    right = [(own.choice([None, 1, 1, 2, 2, own.randint(30, 90), own.randint(200, 260)]), k % 120, f"r{k}") for k in range(200)]
    return left + left[:20], right + right[:9]


@pytest.mark.parametrize("split", [1, 30])
def test_joins_against_spark(spark, monkeypatch, split):
    monkeypatch.setattr(op13_hotjoin, "pieces", lambda spark: split)
    a, b = sides()
    left, right = spark.createDataFrame(a, "k long, id long, x string"), spark.createDataFrame(b, "k long, id long, y string")
    for how in ("inner", "left", "right", "full"):
        got = op13_hotjoin.join(left, right, ["k"], how, words=8)  # a filter so full that false positives remain
        assert got.columns == ["k", "id", "x", "id_right", "y"]
        assert plain_rows(got) == plain_rows(left.join(right.withColumnRenamed("id", "id_right"), "k", how))


def test_joins_of_empty_tables_and_two_keys(spark):
    a, b = sides()
    left, right = spark.createDataFrame(a, "k long, id long, x string"), spark.createDataFrame(b, "k long, id long, y string")
    for how in ("inner", "left", "right", "full"):
        assert plain_rows(op13_hotjoin.join(left, right, ["k", "id"], how)) == plain_rows(left.join(right, ["k", "id"], how))
        assert plain_rows(op13_hotjoin.join(left.limit(0), right, ["k", "id"], how)) == plain_rows(left.limit(0).join(right, ["k", "id"], how))
    with pytest.raises(ValueError, match="different types"):
        op13_hotjoin.join(left, right.withColumn("k", F.col("k").cast("string")), ["k"])


def test_filters(spark):
    a, b = sides()
    left, right = spark.createDataFrame(a, "k long, id long, x string"), spark.createDataFrame(b, "k long, id long, y string")
    whole = op13_hotjoin.bloom(left.union(right.withColumnRenamed("y", "x")), ["k"], 64)
    parts = op13_hotjoin.merged(op13_hotjoin.bloom(left, ["k"], 64), op13_hotjoin.bloom(right, ["k"], 64))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, parts.collect())) and whole.count() == 64
    hit = op13_hotjoin.marked(left, ["k"], op13_hotjoin.bloom(right, ["k"]))
    known = {k for k, *_ in b}
    for r in hit.collect():
        assert r["_hit"] or r["k"] is None or r["k"] not in known  # no key that is there is missed
    assert hit.where("_hit").count() < len(a) / 2 + sum(k in known and k is not None for k, *_ in a)
    assert hit.where("k IS NULL AND _hit").count() == 0


def test_digest_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(op13_hotjoin, "pieces", lambda spark: 20)
    own = random.Random(2)
    tables = []
    for n in (400, 250):
        rows = [(k, own.choice([None, 1, 1, own.randint(2, 40)]), own.choice([None, -0.005, 12.345, 1e9, round(own.random() * 99, 2)])) for k in range(n)]
        tables.append(rows + rows[::17] + rows[::51] + [(None, 1, 2.0)])
    crc = lambda s: zlib.crc32(s.encode())
    plain = []
    for rows in tables:
        out = []
        for i, c, x in rows:
            h = None if i is None else crc(str(i))
            cents = "" if x is None else str(int((100 * x + 0.5) // 1))
            out.append((i, (h // 10) % 7 if h is not None and h % 10 < 3 else c, crc(f"{'' if i is None else i}:{cents}")))
        plain.append(out)
    want = []
    for side, mine, others in (("click", *plain), ("sale", *plain[::-1])):
        by = collections.defaultdict(list)
        for i, c, v in others:
            by[c].append(v)
        ids = collections.defaultdict(list)
        for i, c, _ in mine:
            ids[i].append(c)
        for i, held in ids.items():
            met = [by.get(c, []) if c is not None else [] for c in held]
            inner, full = sum(map(len, met)), sum(max(len(m), 1) for m in met)
            want.append((side, i, min((c for c in held if c is not None), default=None), len(held), inner, full if side == "click" else inner, full, sum(map(sum, met))))
    left, right = (spark.createDataFrame(rows, f"{k} long, client_id long, {x} double").withColumn("id", F.lit("clash")) for rows, k, x in zip(tables, ("click_id", "sale_id"), ("value", "total"), strict=True))
    got = op13_hotjoin.digest(op13_hotjoin.rekeyed(left, "click_id", "value"), op13_hotjoin.rekeyed(right, "sale_id", "total"))
    assert plain_rows(got.select("side", "id", "client_id", "copies", "inner_rows", "left_rows", "full_rows", "partner_crc")) == sorted(want, key=str)
