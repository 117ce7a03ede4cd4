"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text accepts exactly that text's substrings.  A document is read through
it with longest matches: where no match can be continued a phrase ends and the next one begins.  The number of phrases
times the logarithm of the text's length, per letter, is the cross-parsing entropy of Ziv and Merhav; the language
with the least wins.  ``score`` is how far the second best lies behind: 1 - best / second (1 with one language).

Letters are lower-cased, runs of other characters are one gap.  The most frequent letters have a symbol of their own; the
others of the training text are spelt in digits of their code points, so no two of them are alike to the automata; a letter
that no training text has is a phrase.  A document is read whole.
All documents of a batch are cut into lanes of LANE symbols that walk the automata in step as table look-ups; a lane then
takes over the state in which the one before it ended and is read again until both readings are in one state, from
where on they are the same.  So a document's phrases are those of one reading from its first letter to its last.

Training text is bounded: of each language whole labelled texts in the order of their keys' hashes, those of at most an
eighth of ``letters_per_language`` symbols first, until that many are reached (the last one is cut there), and
``languages`` languages at most (those with most rows; with many languages each gets fewer symbols, so that the tables
stay below the broadcast bound).  Each task keeps no more than that a language, so no label gathers in one place.

Null texts and texts without a letter get ``und`` and score 0; where nothing is labelled, all do.  Of languages with equal
entropy the first by name wins, with score 0.  Null keys count as training rows like others (their hash is that of no
text).  Rows give a row each; other columns are ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mixlens.llm import common

#: Symbols of a lane, letters that have a symbol of their own, digits that spell the others, and how many of them.
LANE, LETTERS, DIGITS, SPELT = 512, 60, 17, 5
UNKNOWN = "und"


def automaton(symbols: list[int], width: int) -> np.ndarray:
    """The suffix automaton of a text as a table: at ``state * width + symbol`` the next state times ``width``, or its
    complement where the match ends and the next phrase begins with that symbol."""
    links, length, edges, last = [-1], [0], [{}], 0
    for s in symbols:
        now = len(links)
        links.append(0)
        length.append(length[last] + 1)
        edges.append({})
        p = last
        while p >= 0 and s not in edges[p]:
            edges[p][s] = now
            p = links[p]
        if p >= 0:
            q = edges[p][s]
            if length[p] + 1 == length[q]:
                links[now] = q
            else:
                copy = len(links)
                links.append(links[q])
                length.append(length[p] + 1)
                edges.append(dict(edges[q]))
                while p >= 0 and edges[p].get(s) == q:
                    edges[p][s] = copy
                    p = links[p]
                links[q] = links[now] = copy
        last = now
    unknown = len(links)  # the state within a phrase that is one letter the text lacks
    first = np.full(width, unknown, np.int64)
    for s, q in edges[0].items():
        first[s] = q
    table = np.tile(~(first * width), (unknown + 1, 1))
    table[0] = first * width
    for state, out in enumerate(edges):
        for s, q in out.items():
            table[state, s] = q * width
    table[:, 0] = np.arange(unknown + 1) * width  # fills up lanes and moves nothing
    return table.astype(np.int32).ravel()


@cache
def _folds() -> np.ndarray:
    """Each code point's lower case (a letter), or 0."""
    out = np.zeros(0x110000, np.uint32)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha():
            low = c.lower()
            out[cp] = ord(low) if len(low) == 1 else ord(unicodedata.normalize("NFD", low)[0])
    return out


def letters(text: str) -> np.ndarray:
    """Lower-cased letters and single gaps (0) of a text."""
    found = _folds()[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
    keep = found > 0
    keep[1:] |= found[:-1] > 0
    return found[keep]


class Model:
    """The automata of some languages over one alphabet: 0 fills, 1 is the gap, 2 a letter that none has, then letters and digits."""

    def __init__(self, samples: dict[str, np.ndarray], most: int = 1 << 30) -> None:
        self.languages = sorted(samples)
        every = np.concatenate([s[s > 0] for s in samples.values()]) if samples else np.zeros(0, np.uint32)
        values, counts = np.unique(every, return_counts=True)
        self.own = np.sort(values[np.argsort(-counts, kind="stable")[:LETTERS]])
        self.spelt = np.setdiff1d(values, self.own)
        self.width = 3 + len(self.own) + (DIGITS if len(self.spelt) else 0)
        known = [self.symbols(samples[x])[:most].tolist() for x in self.languages]
        self.tables = [automaton(x, self.width) for x in known]
        self.weight = np.array([math.log2(max(2, len(x))) for x in known])

    def symbols(self, found: np.ndarray) -> np.ndarray:
        out = np.where(found == 0, 1, 2).astype(np.int32)
        if len(self.own):
            at = np.minimum(np.searchsorted(self.own, found), len(self.own) - 1)
            out = np.where(self.own[at] == found, at + 3, out).astype(np.int32)
        rare = np.isin(found, self.spelt) if len(self.spelt) and (out == 2).any() else np.zeros(1, bool)
        if not rare.any():
            return out
        size = np.where(rare, SPELT, 1)
        end = np.cumsum(size)
        spelt = np.repeat(out, size)
        for k in range(SPELT):
            spelt[end[rare] - 1 - k] = 3 + len(self.own) + found[rare] // DIGITS**k % DIGITS
        return spelt

    def phrases(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Letters of each text, and its phrases by language."""
        found = [letters(t) if t else np.zeros(0, np.uint32) for t in texts]
        n = np.array([np.count_nonzero(f) for f in found], np.int64)
        found = [self.symbols(f) for f in found]
        lanes = np.array([-(-len(f) // LANE) for f in found], np.int64)
        total = np.zeros((len(texts), len(self.languages)), np.int64)
        if not lanes.sum():
            return n, total
        grid = np.zeros(lanes.sum() * LANE, np.int32)
        start = np.cumsum(lanes) - lanes
        for f, a in zip(found, start.tolist(), strict=True):
            grid[a * LANE : a * LANE + len(f)] = f
        grid = np.ascontiguousarray(grid.reshape(-1, LANE).T)
        whose = np.repeat(np.arange(len(texts)), lanes)
        begins = np.diff(whose, prepend=-1) != 0
        ends = np.append(begins[1:], True)
        for k, table in enumerate(self.tables):
            state, count = np.zeros(grid.shape[1], np.int32), np.zeros(grid.shape[1], np.int64)
            walked = np.empty_like(grid)  # where each step leads; complemented where a phrase ended
            for row, to in zip(grid, walked, strict=True):
                np.add(state, row, out=state)
                np.take(table, state, out=to, mode="clip")
                ended = to >> 31
                count -= ended
                np.bitwise_xor(to, ended, out=state)
            redo = np.flatnonzero(~begins)
            while len(redo):
                now, changed = state[redo - 1], []
                for row, to in zip(grid, walked, strict=True):
                    new, old = table[now + row[redo]], to[redo]
                    to[redo] = new
                    count[redo] += (old >> 31) - (new >> 31)
                    now, then = new ^ (new >> 31), old ^ (old >> 31)
                    apart = now != then
                    redo, now = redo[apart], now[apart]
                    if not len(redo):
                        break
                state[redo] = now  # these never met: what follows them is read again
                redo = redo[~ends[redo]] + 1
            count += ends & (state > 0)
            total[:, k] = np.bincount(whose, weights=count, minlength=len(texts)).astype(np.int64)
        return n, total

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        n, total = self.phrases(texts)
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        entropy = total * self.weight / np.maximum(n, 1)[:, None]
        order = np.sort(entropy, axis=1)
        best, second = order[:, 0], order[:, min(1, order.shape[1] - 1)]
        score = np.ones(len(texts)) if order.shape[1] == 1 else 1 - best / np.maximum(second, 1e-300)
        names = np.array(self.languages, object)[np.argmin(entropy, axis=1)]
        names[n == 0] = UNKNOWN
        return names.tolist(), np.where(n == 0, 0.0, np.clip(score, 0.0, 1.0))


def sample(labelled: DataFrame, bound: int, languages: int) -> dict[str, np.ndarray]:
    """Training letters from ``lang, text, place``: whole texts of each language up to ``bound`` letters and gaps."""

    def run(batches):
        heaps: dict[str, list] = {}
        held: dict[str, int] = {}
        counts: dict[str, int] = {}
        for batch in batches:
            for lang, place, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                counts[lang] = counts.get(lang, 0) + 1
                heap = heaps.setdefault(lang, [])
                if held.get(lang, 0) >= bound and (0, -place) < heap[0][:2]:
                    continue  # it would be the first to go
                found = letters(text.as_py())
                if not found.any():
                    continue
                heapq.heappush(heap, (-int(8 * len(found) > bound), -place, found[:bound].tobytes()))
                held[lang] = held.get(lang, 0) + min(len(found), bound)
                while held[lang] - len(heap[0][2]) // 4 >= bound:
                    held[lang] -= len(heapq.heappop(heap)[2]) // 4
        for lang, n in counts.items():
            heap = sorted(heaps[lang], reverse=True) or [(0, 0, b"")]
            columns = [pa.array([lang] * len(heap)), pa.array([-x for x, _, _ in heap], pa.int64()), pa.array([-p for _, p, _ in heap], pa.int64()), pa.array([t for _, _, t in heap], pa.binary()), pa.array([n] + [0] * (len(heap) - 1), pa.int64())]
            yield pa.record_batch(columns, ["lang", "long", "place", "found", "n"])

    parts = labelled.select("lang", "place", "text").mapInArrow(common.trimmed(run), common.schema(lang=common.STR, long=common.LONG, place=common.LONG, found=T.BinaryType(), n=common.LONG))
    parts = common.materialize(parts, "sample")
    top = parts.groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang").limit(languages).select("lang")
    before = Window.partitionBy("lang").orderBy("long", "place", "found").rowsBetween(Window.unboundedPreceding, -1)
    kept = parts.join(F.broadcast(top), "lang").withColumn("before", F.coalesce(F.sum(F.octet_length("found") / 4).over(before), F.lit(0)))
    out: dict[str, list[np.ndarray]] = {}
    for r in kept.where(F.col("before") < bound).orderBy("lang", "long", "place", "found").select("lang", "found").collect():
        out.setdefault(r["lang"], []).append(np.append(np.frombuffer(r["found"], np.uint32), np.uint32(0)))
    common.drop(parts)
    return {lang: joined for lang, x in out.items() if (joined := np.concatenate(x)[:bound]).any()}


def fit(labelled: DataFrame, letters_per_language: int = 24_000, languages: int = 256) -> Broadcast:
    """A model of the languages of ``lang, text, place`` (none null), for the executors.  Its size is bounded by the two
    parameters; with more than four languages each gets less text, so that the tables stay below the bound."""
    share = min(letters_per_language, 4 * letters_per_language // max(1, min(languages, labelled.select("lang").distinct().limit(languages).count())))
    model = Model(sample(labelled, share, languages), share)
    if sum(t.nbytes for t in model.tables) > common.MAX_BROADCAST_BYTES:
        raise ValueError("the automata are too large to broadcast")
    return labelled.sparkSession.sparkContext.broadcast(model)


def predict(df: DataFrame, model: Broadcast, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, lang_pred, score`` of each whole text, after them the columns named in ``carry``."""
    along = df.select(*(F.col(f"`{name}`") for name in carry))

    def run(batches):
        for batch in batches:
            for at, size in common.chunks(batch):
                part = batch.slice(at, size)
                names, score = model.value.predict(part.column(1).to_pylist())
                yield pa.record_batch([part.column(0), pa.array(names, pa.string()), pa.array(score), *part.columns[2:]], ["doc_id", "lang_pred", "score", *carry])

    rows = df.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"), *along.columns)
    fields = common.schema(doc_id=common.LONG, lang_pred=common.STR, score=common.DBL)
    return rows.toDF("doc_id", "text", *(f"_{k}" for k in range(len(carry)))).mapInArrow(common.trimmed(run), T.StructType([*fields.fields, *along.schema.fields]))


def held_out(key) -> Column:
    """Whether crc32 of the key as text leaves 2 when divided by 4; false for a null key."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def labelled(docs: DataFrame) -> DataFrame:
    """Training rows: text and label of the documents that aren't held out."""
    known = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    return known.select("lang", F.col("text"), F.xxhash64(F.col("doc_id").cast("string")).alias("place"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from those that aren't held out."""
    docs = common.table(spark, sf_dir, "documents")
    found = predict(docs, fit(labelled(docs)))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
