"""Operators on whole texts against the libraries and brute force, odd rows included."""

import collections
import hashlib
import random
import re
import struct
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mixlens.llm import common, op1_quality, op2_packing, op3_counts, op5_bpe, op6_html, op9_langid
from mixlens.llm.bpe import ByteBPE, Decoder, Transducer

EXTRA = "ids string, words string, piece int, length long, kept string, carried string, hash long, text_ string"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"
rng = random.Random(7)
ODD = [
    None, "", " ", "\n\n \t", "a", "a b", "one two three one two three", "x" * 5000, "ab" * 3000, "ab " * 3000, "don't  'Ll x's", "é Å ﬁ ΣΑΣ İ", " <|endoftext|> x<|endoftext|>",
    "a\x1c b\x1d", "　 a   b\u2003", "1234 ٣٤", "😀😀 ñ \u0000", "= " * 40, "A line.\nA line.\n \nA line.\n", "#1 *2 $3 %4 &5 |6 <7>", "the of and to in " * 40,
    *("".join(rng.choice(" \n\tab'srx1.é　\x85") for _ in range(rng.randint(0, 60))) for _ in range(150)),
]


def frame(spark, texts):
    rows = [(k, t, "en", "s", len(t or ""), "i", "w", 1, 1, "k", "c", 1, "t") for k, t in enumerate(texts)]
    rows += [(None, "no key", "en", "s", 1, "i", "w", 1, 1, "k", "c", 1, "t"), rows[5], rows[5]]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, ODD).cache()


def by_id(df):
    return {r["doc_id"]: r.asDict() for r in df.collect()}


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(common.tokenizer_path(name))


def base(t):
    t = t or ""
    w = re.findall("[^\x20\x09-\x0d]+", t)
    lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    count = collections.Counter(zip(w, w[1:], w[2:]))
    covered = {j for i, x in enumerate(zip(w, w[1:], w[2:])) if count[x] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_quality_base_counts(docs):
    got = op1_quality.assess(docs)
    assert got.count() == docs.count()
    for k, r in by_id(got).items():
        want = base("no key" if k is None else ODD[k])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, (k, ODD[k or 0])
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r["base_failed"] and r["kept"])


def test_quality_rejects_what_resembles_no_language(spark):
    fine = "The river runs to the sea and it is wide. Boats of all sizes go up in the morning, with fish for the town. " * 1
    prose = " ".join(f"{fine} Word{chr(97 + k)}{chr(97 + k * 3 % 26)} is by the {chr(98 + k)}ill." for k in range(12))
    junk = " ".join(f"Zq{k}$$$ hx&&& {k}***" for k in range(120))
    shout = prose.upper()
    got = by_id(op1_quality.assess(spark.createDataFrame([(1, prose), (2, junk), (3, shout)], "doc_id long, text string"), min_words=50))
    assert [got[k]["base_failed"] for k in (2,)] == [False]
    assert not got[2]["kept"] and got[2]["class_distance"] > 0.3 and got[3]["class_distance"] > 0.3 > 0.15 > got[1]["class_distance"]
    own, known = random.Random(4), "the river runs to sea and it is wide boats of all sizes go up in morning with fish for town where people wait by bridge".split()
    varied = " ".join(" ".join(own.choice(known) for _ in range(9)).capitalize() + "," * (k % 3 == 0) + "." for k in range(30))
    assert [r["doc_id"] for r in op1_quality.kept_rows(spark.createDataFrame([(1, varied), (2, junk), (3, prose)], "doc_id long, text string"), ("doc_id",), max_word_distance=1.0).collect()] == [1]
    assert got[1]["base_failed"]  # it says the same sentence again and again


def test_token_counts(spark, docs):
    vocab = op5_bpe.vocabulary(spark, common.tokenizer_path("word_bpe_49k.json"))
    lib = library("word_bpe_49k.json")
    got = op3_counts.count(docs, vocab)
    assert got.count() == docs.count()
    for k, r in by_id(got).items():
        t = "no key" if k is None else ODD[k] or ""
        n = len(lib.encode(t, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(t.encode()), n, n > 2048)


def test_round_trip(spark, docs):
    vocab = op5_bpe.vocabulary(spark, common.tokenizer_path("byte_bpe_50k.json"))
    lib = library("byte_bpe_50k.json")
    encoded = op5_bpe.encode(docs, vocab)
    both = by_id(op5_bpe.round_trip(docs, vocab))
    back = by_id(op5_bpe.decode(encoded, vocab))
    for k, r in by_id(encoded).items():
        ids = lib.encode("no key" if k is None else ODD[k] or "", add_special_tokens=False).ids
        assert bytes(r["ids"]) == bytes(both[k]["ids"]) == struct.pack(f"<{len(ids)}I", *ids)
        assert both[k]["decoded"] == back[k]["text"] == lib.decode(ids, skip_special_tokens=False)


@pytest.fixture(scope="module")
def bpe():
    return ByteBPE.from_json(common.file_bytes(common.tokenizer_path("byte_bpe_50k.json")))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abeinrst -=ÃÂ", min_size=900, max_size=2500))
def test_lookahead_is_sufficient(bpe, text):
    data = text.encode()
    streamed = [x for ids in bpe.stream(data, block=64) for x in ids]
    assert streamed == bpe.merge_long([bpe.byte_id[b] for b in data])


def test_decoder_holds_partial_characters(bpe):
    ids = [bpe.byte_id[b] for b in "é😀".encode()] + [bpe.byte_id[0xFF], bpe.byte_id[0xF0]]
    machine = Decoder(bpe)
    assert "".join(machine.feed(struct.pack("<I", i)) for i in ids) + machine.feed(b"", True) == "é😀\ufffd\ufffd"


def test_memo_is_bounded(bpe, monkeypatch):
    monkeypatch.setattr("mixlens.llm.bpe.MEMO_ENTRIES", 10)
    machine = Transducer(bpe)
    lib = library("byte_bpe_50k.json")
    for k in range(5):
        text = " ".join(f"w{k}x{j}" for j in range(50))
        assert list(np.frombuffer(machine.encode(text), "<u4")) == lib.encode(text, add_special_tokens=False).ids
        assert list(np.frombuffer(machine.encode(text + " again"), "<u4")) == lib.encode(text + " again", add_special_tokens=False).ids
    assert machine.memo.size + machine.older.size < 120


def test_windows_of_any_text(bpe):
    machine, lib = Transducer(bpe), library("byte_bpe_50k.json")
    cases = ["word " * 40_000, "x" * 200_000, "\n" * 150_000 + "x", " " * 140_000, "ab1 " * 3 + "é" * 140_000 + "'s" * 70_000, "<|endoftext|>" * 9000, "a\n" * 100_000, ODD[7] * 30 + " tail"]
    for text in cases:
        before = machine.emitted
        assert list(np.frombuffer(machine.encode(text), "<u4")) == (want := lib.encode(text, add_special_tokens=False).ids)
        assert machine.emitted - before == len(want)
    assert machine.outgrown >= 2
    parts = list(machine.run(cases))
    assert [k for k, _ in parts] == sorted(k for k, _ in parts) and max(len(p) for _, p in parts) <= 4 * 3 * 65_536


def test_a_long_run_keeps_a_bounded_window(bpe):
    seen = []

    def blocks():
        for _ in range(200):
            seen.append(1)
            yield b"ab" * 2048

    most = done = 0
    for ids in bpe.stream(blocks()):
        done += sum(len(bpe.bytes_of[x]) for x in ids)
        most = max(most, 4096 * len(seen) - done)
    assert done == 200 * 4096 and most <= 4 * 4096 + bpe.lookahead


def test_packing(spark, docs):
    lib = library("byte_bpe_50k.json")
    vocab = op5_bpe.vocabulary(spark, common.tokenizer_path("byte_bpe_50k.json"))
    cut = common.materialize(op2_packing.cut(docs, vocab), "t")
    rows = op2_packing.pack(cut).collect()
    assert len(rows) == cut.count()
    pieces = collections.defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
    for k, own in pieces.items():
        ids = lib.encode("no key" if k is None else ODD[k] or "", add_special_tokens=False).ids + [2]
        n = -(-len(ids) // 1024)
        for r in own:
            assert bytes(r["ids"]) == struct.pack(f"<{r['length']}I", *ids[r["start"] : r["start"] + r["length"]])
            assert r["length"] == 1024 or r["piece"] == 0
        assert sorted({r["piece"] for r in own}) == list(range(n)) and sum({r["piece"]: r["length"] for r in own}.values()) == len(ids)
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(r["length"] for r in rows)
    assert len(sequences) <= -(-total // 1024) + 1
    assert zlib.crc32(b"") == 0 and hashlib.sha256(b"").hexdigest().startswith("e3b0")


def best(items, capacity):
    least, items = len(items), sorted(items, reverse=True)

    def go(k, bins):
        nonlocal least
        if len(bins) >= least:
            return
        if k == len(items):
            least = len(bins)
            return
        for room in set(bins):
            if room >= items[k]:
                j = bins.index(room)
                go(k + 1, [*bins[:j], room - items[k], *bins[j + 1 :]])
        go(k + 1, [*bins, capacity - items[k]])

    go(0, [])
    return least


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=10))
def test_plan_is_optimal_on_small_cases(items):
    count = collections.Counter(items)
    made, bound = op2_packing.plan(dict(count), 20)
    used = collections.Counter()
    for pattern, copies in made:
        assert sum(s * m for s, m in pattern) <= 20
        for s, m in pattern:
            used[s] += m * copies
    assert used == count and bound <= best(items, 20) == sum(c for _, c in made)


def best_fit_decreasing(items, capacity):
    rooms = []
    for x in sorted(items, reverse=True):
        fit = [r for r in rooms if r >= x]
        if fit:
            rooms.remove(min(fit))
        rooms.append((min(fit) if fit else capacity) - x)
    return len(rooms)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=120), st.integers(1, 4))
def test_plan_never_makes_more_than_best_fit(items, times):
    items = items * times
    count = collections.Counter(items)
    start = [count[s] for s in range(101)]
    alone = op2_packing.best_fit(start, 100)
    assert sum(c for _, c in alone) == best_fit_decreasing(items, 100)
    made, bound = op2_packing.plan(dict(count), 100)
    for plan in (alone, made):
        used = collections.Counter()
        for pattern, copies in plan:
            assert sum(s * m for s, m in pattern) <= 100
            for s, m in pattern:
                used[s] += m * copies
        assert used == count
    assert bound <= sum(c for _, c in made) <= best_fit_decreasing(items, 100)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{x}</style><script>var a="</p>";</script></head><body><header class="site"><a href="/">Home</a></header>
<nav><ul><li><a>One</a></li></ul></nav><div class="ad">Buy this, now. Really.</div><article><h1>Title &amp; more</h1><p><b>First, part.<br>second</p><p>It goes   on,
and on. And on.<form><input> x</form><p>Last.</article><div id="comments"><p>I liked it, a lot. Yes.</p></div><aside>Side, text.</aside><footer>&copy; us.</footer></body></html>"""


def test_main_text(spark):
    assert op6_html.main_text(PAGE) == "Title & more\nFirst, part. second\nIt goes on, and on. And on.\nLast."
    assert op6_html.main_text(None) == op6_html.main_text("") == op6_html.main_text("<div></div>") == ""
    assert op6_html.main_text("plain &lt; text") == "plain < text"
    assert op6_html.main_text("<p>a<p>b") == "a\nb"
    assert op6_html.main_text("<div>" * 3000 + "x") == "x"
    assert op6_html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    df = spark.createDataFrame([(1, "u", PAGE, "t"), (2, None, None, "t"), (None, "u", "<p>x", "t"), (2, None, None, "t")], "page_id long, url string, html string, text string")
    got = op6_html.extract(df).collect()
    assert len(got) == 4 and {r["n_chars"] for r in got if r["page_id"] == 2} == {0} and all(r["n_chars"] == len(r["text"]) for r in got)


def test_main_text_keeps_all_of_an_article():
    long, some = "Many words, of the long part. " * 60, "A sentence, of ordinary length. " * 5
    for tag in ("section", "div", "blockquote"):
        page = f"<body><nav>Home</nav><article><h1>Head</h1><{tag}><p>{long}</p></{tag}><p>{some}</p><aside>Other</aside></article><p>Foot</p></body>"
        assert op6_html.main_text(page) == f"Head\n{long.strip()}\n{some.strip()}", tag
    parts = [f"<section><p>{long}</p><p>{long}</p></section>", f"<section><p>{some * 3}</p></section>"]
    assert op6_html.main_text(f"<body><div>{''.join(parts)}</div></body>").count("\n") == 2
    page = f"<article><h1>Head</h1><p>Lede</p><div class=body><p>{long}</p><p>{long}</p></div></article>"
    assert op6_html.main_text(page).startswith("Head\nLede\nMany")


ARTICLE = "".join(f"<p>The river {k} runs to the sea, and it is wide. Boats go up in the morning; they come back, full.</p>" for k in range(5))
WANT = "\n".join(f"The river {k} runs to the sea, and it is wide. Boats go up in the morning; they come back, full." for k in range(5))


@pytest.mark.parametrize("wrap", ['<div class="content has-sidebar">%s</div>', '<div class="post share-enabled">%s</div>', '<div class="entry comments-open">%s</div>', '<div id="main-menu-page">%s</div>', '<article><div class="banner">%s</div></article>', '<div class="zz">%s</div>'])
def test_names_are_no_verdict(wrap):
    page = f"<body><nav><a>Home</a> <a>About us</a></nav>{wrap % ARTICLE}<div class=footer>(c) us</div></body>"
    assert op6_html.main_text(page) == WANT


def test_ratios_remove_what_no_list_names():
    links = "".join(f"<li><a href=/{k}>Topic {k}</a></li>" for k in range(30))
    short = "".join(f"<div>tag {k}</div>" for k in range(20))
    page = f"<body><div class=q1><ul>{links}</ul></div><div class=q2><div class=q3>{ARTICLE}<ul>{links}</ul></div><div class=q4>{short}</div></div><div class=q5>Call 555</div></body>"
    assert op6_html.main_text(page) == WANT
    found = op6_html.blocks(page)
    score = dict(zip([t for _, t, _ in found], op6_html.scores(found).tolist(), strict=True))
    assert score["Topic 3"] == min(score.values()) and max(score, key=score.get) in WANT


def test_hostile_pages_are_linear():
    for page in ("<x>" * 60_000 + "</y>" * 60_000 + "x", "<p><table>" + "<x>" * 30_000 + "<h1>a" * 30_000, "<div>a" * 20_000, "<ul>" + "<li>a" * 50_000, "<" * 50_000, "<table>" + "<tr><td>a" * 30_000):
        start = time.process_time()
        op6_html.main_text(page)
        assert time.process_time() - start < 10


def phrases(sample, text):
    flat = lambda t: "".join(chr(c) if c else " " for c in op9_langid.letters(t))
    s, t = flat(sample), flat(text)
    n = i = 0
    while i < len(t):
        j = i + 1
        while j <= len(t) and t[i:j] in s:
            j += 1
        n, i = n + 1, max(i + 1, j - 1)
    return n


@settings(max_examples=200, deadline=None)
@given(st.text("abc d", min_size=1, max_size=40), st.text("abcz d.", min_size=1, max_size=80))
def test_phrases_are_longest_matches(sample, text):
    if not any(map(str.isalpha, sample)):
        return
    model = op9_langid.Model({"x": op9_langid.letters(sample)})
    assert model.phrases([text])[1][0, 0] == phrases(sample, text)


def test_scores_against_brute_force():
    own = random.Random(12)
    make = lambda letters_, n: " ".join("".join(own.choice(letters_) for _ in range(own.randint(2, 6))) for _ in range(n))
    known = {"a": make("abcde", 80), "b": make("cdefg", 80), "c": make("abefg", 80)}
    model = op9_langid.Model({x: op9_langid.letters(t) for x, t in known.items()})
    texts = [make(own.choice(["abcde", "cdefg", "abefg"]), own.randint(1, 60)) for _ in range(30)]
    names, scores = model.predict(texts)
    for text, name, score in zip(texts, names, scores.tolist(), strict=True):
        entropy = {x: phrases(t, text) * np.log2(len(op9_langid.letters(t))) / sum(map(str.isalpha, text)) for x, t in known.items()}
        first, second = sorted(entropy.values())[:2]
        assert entropy[name] == first and name == min(x for x in entropy if entropy[x] == first)
        assert abs(score - (1 - first / second)) < 1e-9


def test_lanes_do_not_show(monkeypatch):
    own = random.Random(3)
    texts = ["".join(own.choice("abc d") for _ in range(own.randint(0, 400))) for _ in range(60)] + ["a" * 500, "abcabcabd" * 60, "жабц" * 90, "漢字仮名漢字" * 40]
    model = op9_langid.Model({"x": op9_langid.letters("abc dab cdd aab bca" * 30 + "aaaa"), "y": op9_langid.letters("abcabcabd" * 70 + "漢字仮名")})
    many = {}
    for lane in (1 << 14, 64, 7):
        monkeypatch.setattr(op9_langid, "LANE", lane)
        many[lane] = model.phrases(texts)[1].tolist()
    assert many[7] == many[64] == many[1 << 14]
    assert [x[0] for x in many[7]][:60] == [phrases("abc dab cdd aab bca" * 30 + "aaaa", t) if t else 0 for t in texts[:60]]


def test_rare_letters_differ(monkeypatch):
    monkeypatch.setattr(op9_langid, "LETTERS", 3)
    han = "".join(chr(0x4E00 + 7 * k) for k in range(300))
    model = op9_langid.Model({"a": op9_langid.letters(han), "b": op9_langid.letters(han[::-1])})
    names, _ = model.predict([han[40:90], han[::-1][40:90], "123"])
    assert names == ["a", "b", "und"]


def test_language(spark):
    words = {"en": "the of and to in that was with from this", "de": "der die und den von zu das mit sich auf", "xx": "qua zor blim tuk wem"}
    make = lambda x: " ".join(rng.choice(words[x].split()) for _ in range(60))
    rows = [(k, make(x), x) for k, x in enumerate(["en", "de", "xx"] * 40)]
    train = spark.createDataFrame([*rows, (900, None, "en"), (901, "text", None)], "doc_id long, text string, lang string")
    model = op9_langid.fit(op9_langid.labelled(train), letters_per_language=2000)
    odd = spark.createDataFrame([(None, make("de")), (1, None), (2, ""), (3, "123 .."), (4, make("xx")), (5, make("en") * 200)], "doc_id long, text string")
    got = by_id(op9_langid.predict(odd, model))
    assert {k: r["lang_pred"] for k, r in got.items()} == {None: "de", 1: "und", 2: "und", 3: "und", 4: "xx", 5: "en"}
    assert all(0 <= r["score"] <= 1 for r in got.values())
    right = by_id(op9_langid.predict(train.where("text is not null and lang is not null"), model))
    assert all(right[k]["lang_pred"] == x for k, _, x in rows)
    none = op9_langid.fit(op9_langid.labelled(train.where("false")))
    assert {r["lang_pred"] for r in op9_langid.predict(odd, none).collect()} == {"und"}


def test_empty_tables(spark, docs):
    none = docs.where("false")
    vocab = op5_bpe.vocabulary(spark, common.tokenizer_path("byte_bpe_50k.json"))
    words = op5_bpe.vocabulary(spark, common.tokenizer_path("word_bpe_49k.json"))
    assert op1_quality.assess(none).count() == op3_counts.count(none, words).count() == op5_bpe.round_trip(none, vocab).count() == op2_packing.run(none).count() == 0
