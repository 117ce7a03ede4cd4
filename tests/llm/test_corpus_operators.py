"""Operators over whole tables against brute force, odd rows included; the pipeline."""

import collections
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from mixlens.llm import common, op4_urls, op7_topk, op8_substring, op9_langid, op10_jaccard, registry

rng = random.Random(11)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, token long, hash long, component_id long"


def frame(spark, rows):
    return spark.createDataFrame([(k, t, "en", "s", len(t or ""), 1, 2, 3) for k, t in rows], SCHEMA)


def word():
    return "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 5)))


def near(text):
    w = text.split(" ")
    for _ in range(rng.randint(0, 3)):
        w[rng.randrange(len(w))] = word()
    return " ".join(w)


def corpus():
    rows, passage = [], " ".join(word() for _ in range(60)) + "."
    for k in range(40):
        own = [" ".join(word() for _ in range(rng.randint(3, 9))).capitalize() + rng.choice([". ", "! ", ".\n"]) for _ in range(rng.randint(1, 12))]
        if k % 4 == 0:
            own.insert(rng.randrange(len(own) + 1), passage + " ")
        text = "".join(own)
        rows += [(3 * k + 1, text), *((3 * k + 2 + j, near(text)) for j in range(k % 3))]
    rows += [(500 + k, "same words all of them here in a row") for k in range(25)]
    rows += [(600, None), (601, ""), (602, " \n"), (603, "one"), (604, "One"), (605, "two words"), (606, passage * 300), (None, "no key at all in this row"), (603, "one")]
    return rows


def shingles(t, k):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall("[^\x20\x09-\x0d]+", t or "")]
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80), (2, 50)])
def test_jaccard_components(spark, k, percent):
    rows = corpus()
    sets = {d: shingles(t, k) for d, t in rows if d is not None}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = op10_jaccard.link(frame(spark, rows), k, percent).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None
        else:
            assert (r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), find(r["doc_id"])), r["doc_id"]


def test_jaccard_order_does_not_decide(spark, monkeypatch):
    rows = corpus()
    want = {tuple(r) for r in op10_jaccard.link(frame(spark, rows)).collect()}
    monkeypatch.setattr(op10_jaccard, "FREQUENT_LEAST", 3)
    monkeypatch.setattr(op10_jaccard, "BROADCAST_HASHES", 0)
    monkeypatch.setattr(op10_jaccard, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(op10_jaccard, "HOT_LEAST", 3)
    assert {tuple(r) for r in op10_jaccard.link(frame(spark, rows)).collect()} == want


def test_jaccard_members_beside_the_least(spark):
    z = [f"long{j:02}word" for j in range(20)] + [f"w{j:02}" for j in range(40)]
    rows = [(0, " ".join(z[:30] + z[31:])), (1, " ".join(z[:45] + z[46:])), (2, " ".join(z))]
    assert {r["component_id"] for r in op10_jaccard.link(frame(spark, rows)).collect()} == {0}


def test_classes_of_one_group_meet(spark):
    own = random.Random(9)
    rows = []
    for g in range(6):  # one long rare beginning each, so one prefix, and tails that are alike in pairs
        head = [f"veryrarelongword{g}x{j}" for j in range(12)]
        for m in range(8):
            tail = [f"t{g}{m // 2}{j}" for j in range(38)]
            if m % 2:
                tail[own.randrange(20, 38)] += "y"
            rows.append((100 * g + m, " ".join(head + tail)))
    for percent in (60, 85):
        sets = {d: shingles(t, 4) for d, t in rows}
        root = {d: d for d in sets}
        for _ in sets:
            for a in sets:
                for b in sets:
                    if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                        root[a] = root[b] = min(root[a], root[b])
        got = {r["doc_id"]: r["component_id"] for r in op10_jaccard.link(frame(spark, rows), 4, percent).collect()}
        assert got == root


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80), (2, 95), (4, 50)])
def test_links_of_isolated_pairs(spark, k, percent):
    """Pairs of texts apart from all others, one made from the other by a run of words before, behind, taken out, put in or
    changed in single places: no link may be lost, whatever of the order lies behind a prefix."""
    own = random.Random(k * percent)
    long_word = lambda n=0: "".join(own.choice("abcdefghijklmnop") for _ in range(n or own.randint(2, 14)))
    rows, kinds = [], ("front", "behind", "out", "in", "single")
    for p in range(400):
        a = [long_word() for _ in range(own.randint(20, 120))]
        part, kind = 1 + own.randrange(max(1, (120 - percent) * len(a) // 100)), kinds[p % 5]
        at = own.randrange(len(a))
        run = [long_word(own.choice([0, 20])) for _ in range(part)]
        b = {"front": run + a, "behind": a + run, "out": a[:at] + a[at + part :], "in": a[:at] + run + a[at:]}.get(kind)
        if b is None:
            b = a.copy()
            for _ in range(1 + part // 5):
                b[own.randrange(len(b))] = long_word()
        rows += [(2 * p, " ".join(a)), (2 * p + 1, " ".join(b))]
    sets = {d: shingles(t, k) for d, t in rows}
    alike = {2 * p for p in range(400) if 100 * len(sets[2 * p] & sets[2 * p + 1]) >= percent * len(sets[2 * p] | sets[2 * p + 1])}
    got = {r["doc_id"]: r["component_id"] for r in op10_jaccard.link(frame(spark, rows), k, percent).collect()}
    assert 40 < len(alike) < 400 and {d for d in got if d % 2 == 0 and got[d + 1] == d} == alike
    assert all(got[d] == d for d in got if d % 2 == 0)


def test_links_under_varied_white_space(spark):
    own = random.Random(5)
    rows = []
    for k in range(200):
        w = ["".join(own.choice("abcdefghij") for _ in range(own.randint(2, 9))) for _ in range(63)]
        v = w.copy()
        v[own.randrange(63)] = "changed"
        rows += [(2 * k + j, "".join(x + own.choice([" ", "  ", "\r\n", "\n\n   "]) for x in t)) for j, t in enumerate((w, v))]
    sets = {d: shingles(t, 4) for d, t in rows}
    alike = [k for k in range(200) if 100 * len(sets[2 * k] & sets[2 * k + 1]) >= 85 * len(sets[2 * k] | sets[2 * k + 1])]
    got = {r["doc_id"]: r["component_id"] for r in op10_jaccard.link(frame(spark, rows)).collect()}
    assert len(alike) > 100 and [k for k in range(200) if got[2 * k + 1] == 2 * k] == alike


def test_white_space_does_not_order_shingles(spark):
    own = random.Random(2)
    texts = [" ".join("abcdefgh"[k] * own.randint(1, 5) + str(j) for j in range(60)) for k in range(8)]
    spaced = ["".join(x + own.choice([" ", "   ", "\r\n", "\n\n    "]) for x in t.split(" ")) for t in texts]
    for a, b in zip(op10_jaccard.shingles(["two words", *texts], 4), op10_jaccard.shingles(["two \r\n words", *spaced], 4), strict=True):
        assert all(map(np.array_equal, a, b))
    rows = [(10 * k + j, t) for k, (t, s) in enumerate(zip(texts, spaced, strict=True)) for j, t in enumerate([s, t, f"{t} more"])]
    assert all(r["component_id"] == r["doc_id"] // 10 * 10 for r in op10_jaccard.link(frame(spark, rows)).collect())


def test_sentence_spans(spark, monkeypatch):
    monkeypatch.setattr(op8_substring, "HOT_LEAST", 4)
    shared = "Now this passage stands in several texts of the table. It has more than one sentence, and it has enough words to count as repeated. So it goes."
    rows = [(5, f"Own beginning here. {shared} Own end."), (2, f"{shared}\nAnother end of another text."), (9, f"A third one says. {shared.upper()}"), (7, "Short. Same. Short. Same."), (8, "Short. Same. Short. Same."), (None, shared), (11, None), (12, ""), (13, " \n "), (14, "x" * 50_000)]
    rows += [(k, f"Line {k}x{k} is its own. {shared}") for k in range(100, 112)]
    got = {r["doc_id"]: r for r in op8_substring.dedup(frame(spark, rows)).collect()}
    assert len(got) == len(rows)
    assert got[2]["n_removed"] == 0 and got[2]["text"] == rows[1][1]
    assert got[5]["text"] == "Own beginning here. Own end." and got[5]["n_removed"] >= 3
    assert got[9]["text"] == "A third one says. "
    assert got[7]["text"] == got[8]["text"] == rows[3][1]
    assert got[None]["text"] == shared and got[11]["text"] is None and got[12]["text"] == "" and got[13]["n_sentences"] == 0
    assert all(got[k]["text"] == f"Line {k}x{k} is its own. " for k in range(100, 112))


def brute_spans(rows, sentences=2, words=12, long_words=15):
    """Texts without the sentences that a span repeated from an earlier place covers, by the spans' own words."""
    cuts, seen, out = {}, {}, {}
    for key, text in sorted((r for r in rows if r[0] is not None and r[1] is not None), key=lambda r: r[0]):
        cut = op8_substring.Cut([text], sentences, words, long_words)
        edge = [0, *cut.at.tolist()[1:], len(text.encode())] if len(cut.at) else [0, len(text.encode())]
        raw = text.encode()
        cuts[key] = [raw[a:b] for a, b in zip(edge, edge[1:])]
        count = [len(p.split()) for p in cuts[key]]
        gone = set()
        for j in range(len(cuts[key])):
            stop = next((k for k in range(j + sentences, len(count) + 1) if sum(count[j:k]) >= words), None)
            if stop:
                span = b" ".join(b"".join(cuts[key][j:stop]).lower().split())
                if seen.setdefault(span, (key, j)) != (key, j):
                    gone |= set(range(j, stop))
        out[key] = (b"".join(p for k, p in enumerate(cuts[key]) if k not in gone).decode(), len(gone))
    return out


@pytest.mark.parametrize("places", [0, 1 << 20])
def test_spans_against_brute_force(spark, monkeypatch, places):
    monkeypatch.setattr(op8_substring, "BROADCAST_PLACES", places)
    rows = [r for r in corpus() if r[0] is not None]
    rows = list({k: (k, t) for k, t in rows}.values())
    want = brute_spans(rows)
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in op8_substring.dedup(frame(spark, rows)).collect()}
    assert {k: got[k] for k in want} == want and len(got) == len(rows)
    assert sum(n for _, n in want.values()) > 20


def test_passages_are_cut_alike_anywhere(spark):
    passage = " ".join(word() for _ in range(55))
    fill = lambda: " ".join(word() + word() for _ in range(rng.randint(3, 30)))
    rows = [(k, f"{fill()} {passage} {fill()}.") for k in range(30)]
    got = op8_substring.dedup(frame(spark, rows)).collect()
    kept = [r["doc_id"] for r in got if passage in r["text"]]
    assert kept == [0]
    clean = [(k, ". ".join(fill() for _ in range(5))) for k in range(30)]
    assert all(r["n_removed"] == 0 for r in op8_substring.dedup(frame(spark, clean)).collect())


def test_every_passage_holds_a_span():
    own = random.Random(4)
    marks = ["", "", "", ",", "."]
    for few in (3, 1000, 1000):
        for trial in range(400):
            some = marks[: own.randint(1, 5)]
            make = lambda n, p: " ".join(f"{p}{own.randrange(few)}" + (own.choice(some) if own.random() < 0.15 else "") for _ in range(n))
            passage = make(51, "w")
            texts = [f"{make(own.randint(0, 25), a)} {passage} {make(own.randint(0, 25), a)}" for a in "ab"]
            cut = op8_substring.Cut(texts, 2, 12, 15)
            x, y = (set(cut.hash[cut.first[k] : cut.first[k + 1]].tolist()) - {0} for k in (0, 1))
            assert x & y, (few, trial, texts)


URLS = ["https://a.spam.net/x", "http://EXAMPLE.net/en/1", "http://www.example.net/en/1?x=/de/", "http://notexample.net/en/", "http://example.com/de/", "http://m.example.com/de", "http://x.org/fr/#a", "http://x.org?fr/", "http://listed.org", "nothing", "://", "", None, "ftp://u@h:80/p?q#r", "http://a.b/c://d", "http://listed.org/" + "x" * 200_000]


@pytest.mark.parametrize("bits", [1 << 27, 64])
def test_url_verdicts(spark, monkeypatch, bits):
    monkeypatch.setattr(op4_urls, "MAX_BITS", bits)
    df = spark.createDataFrame([(k, u, "h", "r") for k, u in enumerate(URLS)] + [(None, "http://listed.org/", "h", "r")], "page_id long, url string, host string, rule string")
    listed = spark.createDataFrame([("listed.org",), ("elsewhere.org",), (None,), *((f"none{k}.org",) for k in range(9))], "key string")
    got = {r["page_id"]: r for r in op4_urls.judge(df, listed).collect()}

    def brute(u):
        rest = u.partition("://")[2] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0].lower()
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        fits = [(len(h + p), h + p, v) for v, h, p in op4_urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else "block" if host == "listed.org" else "allow"

    assert len(got) == len(URLS) + 1
    for k, u in [*enumerate(URLS), (None, "http://listed.org/")]:
        assert tuple(got[k][c] for c in ("host", "path", "rule", "verdict")) == brute(u), u
    assert op4_urls.judge(df.where("false"), listed).count() == 0


def test_cascade_is_exact(spark):
    universe = spark.range(5000).select(F.concat(F.lit("h"), "id").alias("key"))
    listed = universe.where("key like '%7'")
    levels = op4_urls.cascade(universe, listed)
    assert len(levels) > 1
    marked = universe.withColumn("m", op4_urls.member(F.col("key"), levels))
    assert marked.where("m <> (key like '%7')").count() == 0


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_against_sql(spark, name):
    root = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for table in ("pages", "documents", "embeddings", "conversations", "clicks", "sales"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{root}/{table}.parquet')")
    df = registry.queries()[name](spark, root)
    cur = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    got = sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)
    assert got == sorted(cur.fetchall(), key=str)


def test_top_k(spark):
    r = np.random.default_rng(5)
    vectors = [(k, [float(x) for x in r.normal(0, 0.2, 6)]) for k in range(700)]
    vectors += [(k, vectors[3][1]) for k in range(700, 760)] + [(800, [0.0] * 6), (900, None), (901, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (902, [float("nan")] * 6), (903, [float("inf")] * 6), (1000, [1.0, 2.0]), (1100, [0.5, 1.0]), (None, [0.1] * 6), vectors[100], (1200, [])]
    df = spark.createDataFrame([(k, v, 1, 2, 3) for k, v in vectors], "vec_id long, embedding array<double>, label int, id long, score long")
    got = op7_topk.top_k(df, F.col("id") % 100 == 0).collect()
    good = {k: np.floor(1024 * np.array(v, float)).astype(int) for k, v in vectors if k is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    want = set()
    for q, x in good.items():
        if q % 100 == 0:
            scores = sorted((-int(x @ y), k) for k, y in good.items() if k != q and len(y) == len(x))[:10]
            want |= {(q, j + 1, k, -s) for j, (s, k) in enumerate(scores)}
    assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got} == want and len(got) == len(want)
    assert op7_topk.top_k(df.where("false"), F.col("id") % 100 == 0).count() == 0


def test_repeated_rows_take_one_place():
    r = np.random.default_rng(8)
    x = np.floor(1024 * r.normal(0, 0.1, (2000, 16))).astype(np.int64)
    query = x[1]
    often = np.tile(query * 2, (1500, 1))
    clash = np.stack([query * 2 - j for j in range(40)])  # one key, many vectors
    keys, vectors = np.concatenate([np.arange(2000), np.full(1500, 5000), np.full(40, 6000)]), np.concatenate([x, often, clash])
    mixed = r.permutation(len(keys))
    keys, vectors = keys[mixed], vectors[mixed]
    rows = {(-int(v @ query), int(k)) for k, v in zip(keys, vectors, strict=True) if k != 1}
    for k in (10, 60):
        best = op7_topk.Best(k)
        for at in range(0, len(keys), 1800):
            best.add(1, *op7_topk.Index(keys[at : at + 1800], vectors[at : at + 1800]).best(1, query, k))
        assert [(-s, i) for i, s in zip(*(x.tolist() for x in best.of[1]), strict=True)] == sorted(rows)[:k]


def test_proofs_exclude_most_vectors():
    r = np.random.default_rng(6)
    x = np.floor(1024 * r.normal(0, 0.1, (4000, 16))).astype(np.int64)
    index = op7_topk.Index(np.arange(4000), x)
    left = [len(index.possible(k, x[k].astype(float), 10)) for k in range(20)]
    assert max(left) < 4000 and sum(left) < 20 * 1000
    assert index.skipped > 0.05 * (index.read + index.skipped)


def prose(n):
    common_ = "the of and to in a is that for it was on as with by".split()
    return " ".join(" ".join(rng.choice(common_) if rng.random() < 0.35 else word() + word() for _ in range(rng.randint(5, 12))).capitalize() + "." for _ in range(n))


def test_pipeline(spark, tmp_path):
    texts = [prose(rng.randint(14, 40)) for _ in range(30)]
    rows = [(k, t) for k, t in enumerate(texts)]
    rows += [(100 + k, texts[k]) for k in range(5)] + [(200, near(texts[6])), (300, None), (301, ""), (302, "short"), (303, "!!! " * 300), (0, texts[0]), (None, prose(20))]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = common.materialize(stage(spark, docs, str(tmp_path)), name)
        seen[name] = docs
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert seen[name].columns == list(corpus_pipeline.COLUMNS)
    ids = {n: collections.Counter(r[0] for r in d.select("doc_id").collect()) for n, d in seen.items()}
    assert set(range(30)) <= set(ids["quality"]) and not {300, 301, 302, 303} & set(ids["quality"])
    assert ids["near_duplicates"][0] == 1 and not set(range(100, 105)) & set(ids["near_duplicates"]) and set(range(30)) <= set(ids["near_duplicates"])
    assert None in ids["packing"] and set(range(30)) <= set(ids["packing"])
    assert sum(ids["packing"].values()) == corpus_pipeline.run(spark, str(tmp_path)).count()


def test_stages_on_odd_tables(spark):
    none = frame(spark, [(1, "x")]).where("false")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, "").count() == 0, name
    long = prose(30)
    rows = frame(spark, [(5, long), (5, prose(20)), (2, long), (None, prose(20)), (7, None)])  # with clashing columns
    kept = corpus_pipeline.STAGES[2][1](spark, rows, "").collect()
    assert sorted((r["doc_id"] or 0, r["text"] == long) for r in kept) == [(0, False), (2, True), (5, False), (7, False)]


def test_empty_tables(spark):
    none = frame(spark, [(1, "x")]).where("false")
    assert op10_jaccard.link(none).count() == op8_substring.dedup(none).count() == 0
    assert op9_langid.predict(none, op9_langid.fit(op9_langid.labelled(none))).count() == 0


def test_registry():
    names = list(registry.queries())
    assert "pipeline" in names and [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10
    assert set(registry.oracle_sql()) <= set(names)
