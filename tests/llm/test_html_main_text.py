"""Main text of pages: what belongs to the article, and the path ratios against a plain second computation."""

import html.parser
import math
import re

import pytest

from mixlens.llm import op6_html

LONG = "A long block of the sidebar, with commas, and more. " * 7
COMMENTS = "".join(f"<div class=c><b>U{k}</b><p>I think this is, well, a comment number {k}.</p></div>" for k in range(4))
SIGNED = "".join(f"<li><div><span class=username>U{k}</span> <time>1 May</time></div><p>I think this is, well, a comment number {k}.</p></li>" for k in range(4))


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<article><p>One, two and three.</p><ul><li><a href=x>Ref one</a></li><li><a href=y>Ref two</a></li></ul><p>Four, five and six.</p></article>", "One, two and three.\nRef one\nRef two\nFour, five and six."),
        (f"<body><div class=sidebar><p>{LONG}</p></div><article><h1>T</h1><p>Hi.</p><p>Short one.</p></article></body>", "T\nHi.\nShort one."),
        (f"<body><article><h1>T</h1><p>Text of it, all in one.</p><p>Second.</p><section class='reader-discussion'><h3>4 said</h3>{COMMENTS}</section></article></body>", "T\nText of it, all in one.\nSecond."),
        (f"<body><article><h1>T</h1><p>Text of it, all in one.</p><p>Second.</p><section class=x><h3>4 said</h3><ol>{SIGNED}</ol></section></article></body>", "T\nText of it, all in one.\nSecond."),
        ("<body><article><header><div class=byline>By X</div></header><h1>T</h1><section class=s><h2>A</h2><p>One, two.</p></section><section class=s><h2>B</h2><p>Three, four.</p></section></article></body>", "By X\nT\nA\nOne, two.\nB\nThree, four."),
        ("<body><main><article class=a><h2>A</h2><time>1</time><p>First, of two.</p></article><article class=a><h2>B</h2><time>2</time><p>Second, of two.</p></article></main></body>", "A\n1\nFirst, of two.\nB\n2\nSecond, of two."),
        ("<body><div id=c><p>One, two and three, more or less.</p><ul><li><a href=x>Ref one</a></li></ul><p>Four, five and six, at last.</p><ul class=z><li><a href=q>Out</a></li></ul></div></body>", "One, two and three, more or less.\nRef one\nFour, five and six, at last."),
        (f"<ol class=thread>{SIGNED}</ol>", None),  # nothing but comments: kept
    ],
)
def test_what_belongs_to_the_article(page, want):
    got = op6_html.main_text(page)
    assert got == want if want is not None else "comment number 3" in got


def pages(spark, n=120):
    return [r["html"] for r in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").orderBy("page_id").limit(n).collect() if r["html"]]


class Texts(html.parser.HTMLParser):
    """All text outside scripts and the like, without white space."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.raw, self.out = 0, []
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.raw += tag in op6_html.RAW

    def handle_endtag(self, tag):
        self.raw -= tag in op6_html.RAW and self.raw > 0

    def handle_data(self, data):
        if not self.raw:
            self.out.append(data)


def test_blocks_hold_all_text(spark):
    for page in pages(spark):
        assert "".join(t for _, t, _ in op6_html.blocks(page)).replace(" ", "") == re.sub(r"\s", "", "".join(Texts(page).out))


def plain_scores(found):
    """Ratios by path, smoothed, fused and averaged by path, in plain loops."""
    by = {}
    for e, t, linked in found:
        by.setdefault(e.name, []).append((len(t) - linked, len(op6_html.PUNCTUATION.findall(t))))
    ratio = {p: [sum(x[k] for x in v) / len(v) for k in (0, 1)] for p, v in by.items()}
    weights = [math.exp(-(d * d) / 2) for d in range(-2, 3)]

    def smoothed(k, i):
        around = [ratio[found[min(max(i + d, 0), len(found) - 1)][0].name][k] for d in range(-2, 3)]
        return sum(w * x for w, x in zip(weights, around)) / sum(weights)

    fused = [smoothed(0, i) * math.sqrt(1 + smoothed(1, i)) * e.weight for i, (e, _, _) in enumerate(found)]
    own = {}
    for (e, _, _), f in zip(found, fused):
        own.setdefault(e.name, []).append(f)
    return [sum(own[e.name]) / len(own[e.name]) for e, _, _ in found]


def chain(e):
    out = []
    while e is not None:
        out.append(e)
        e = e.parent
    return out[::-1]


def plain_text(page):
    """The main text of a page without comments, by the same rules in plain loops."""
    found = [x for x in op6_html.blocks(page) if x[0].weight > 0]
    score = plain_scores(found)
    mean = lambda rows: sum(score[k] * len(found[k][1]) for k in rows) / sum(len(found[k][1]) for k in rows)
    every = range(len(found))
    own = [k for k in every if found[k][0].article and not found[k][0].against and 2 * found[k][2] < len(found[k][1])]
    chosen = [k for k in own or every if score[k] >= 0.5 * mean(own or every)]
    above = [chain(found[k][0].parent if found[k][0].tag in op6_html.LEAVES else found[k][0]) for k in chosen]
    node = [level[0] for level in zip(*above) if len({x.number for x in level}) == 1][-1]
    node = next((x for x in chain(node)[::-1] if x.tag in op6_html.MAIN_TAGS), node)
    out = []
    for k, (e, t, _) in enumerate(found):
        path = [x for x in found if x[0].name == e.name]
        links = 2 * sum(x[2] for x in path) > sum(len(x[1]) for x in path)
        whole = node.article or node.tag in op6_html.MAIN_TAGS or chosen[0] < k < chosen[-1]
        if node in chain(e) and (score[k] >= 0.5 * mean(every) or not e.against and (whole or not links)):
            out.append(t)
    return "\n".join(out)


def test_ratios_and_choice_against_plain_loops(spark):
    compared = 0
    for page in pages(spark):
        found = [x for x in op6_html.blocks(page) if x[0].weight > 0]
        assert op6_html.scores(found).tolist() == pytest.approx(plain_scores(found), rel=1e-9)
        if not op6_html.comments(found).any():
            compared += 1
            assert op6_html.main_text(page) == plain_text(page)
    assert compared > 50
