"""Substring dedup by sliding sentence spans.

A sentence ends at a word that ends in one of ``.!?;:``, and at a line end; one of more than ``long_words`` words is cut
after its commas and, in every WINDOW words without a cut so far, after those whose hash is least, so that a passage is
cut alike wherever it stands, and no piece of a long sentence has more than WINDOW words.  Whether a word is cut after
depends on fewer than WINDOW words on either side: a passage of over 50 words holds a whole span.  From each sentence runs the shortest span of at least ``sentences`` sentences and ``words`` words; words count without regard to
ASCII case and white space.  Spans are joined globally by a 64-bit hash; the first place of each (by key, then place)
stays, and every sentence that any other place of a repeated span covers is removed, if 32 bits of a second, independent
hash agree with the first place's: what only shares a hash is left as it is.

Counts and first places combine before the shuffle.  Hashes above HOT places (a thousandth of a percent of all, at least
HOT_LEAST), of which there can be no more than 100,000, are broadcast with their first places, so that their rows never
meet in one task; the others are joined.  No list is longer than a text's sentences.  Texts are not shuffled as long as
the places to remove are few enough to broadcast (BROADCAST_PLACES); beyond that they are joined with them by key.

Null texts give null and no sentences; rows with a null key pass unchanged and repeat nothing; rows that share key and
text are one text, and keep or lose the same sentences; rows that share only the key are told apart by their text.  An
empty table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mixlens.llm import common
from mixlens.llm.shingles import _power, mix, words

#: A hash with more places than all / HOT_PART, and than HOT_LEAST, is hot.
HOT_PART, HOT_LEAST = 100_000, 1000
#: Places to remove that may be broadcast (some 20 bytes each).
BROADCAST_PLACES = 2_000_000

#: Words of which one at least ends a piece of a long sentence.
WINDOW = 9

_enders = np.zeros(256, bool)
_enders[list(b".!?;:")] = True


def least_of_windows(values: np.ndarray) -> np.ndarray:
    """Whether a value is 0, or the least of WINDOW consecutive values around it."""
    out, m = values == 0, len(values) - WINDOW + 1
    if m > 0:
        low = values[:m].copy()
        for j in range(1, WINDOW):
            np.minimum(low, values[j : j + m], out=low)
        for j in range(WINDOW):
            out[j : j + m] |= values[j : j + m] == low
    return out


class Cut:
    """The sentences of many texts and the span that begins at each."""

    def __init__(self, texts: list[str | None], sentences: int, least: int, long_words: int) -> None:
        self.raw = [(t or "").encode() for t in texts]
        data = np.frombuffer(b" ".join([*self.raw, b""]), np.uint8)
        h, start, end, first = words(texts)
        n = len(h)
        self.text_at = np.concatenate([[0], np.cumsum([len(r) + 1 for r in self.raw])])
        if not n:
            self.at, self.hash, self.sure, self.run = *(np.zeros(0, np.int64) for _ in range(2)), *(np.zeros(0, np.int32) for _ in range(2))
            self.first = np.zeros(len(texts) + 1, np.int64)
            return
        lines = np.concatenate([[0], np.cumsum(data == 10)])
        ends = _enders[data[end - 1]]
        ends[:-1] |= lines[start[1:]] > lines[end[:-1]]
        ends[first[1:][first[1:] > first[:-1]] - 1] = True
        number = np.cumsum(ends) - ends
        size = np.bincount(number)[number]
        ends |= (size > long_words) & least_of_windows(np.where(ends | (data[end - 1] == 44), np.uint64(0), h | np.uint64(1)))
        last = np.flatnonzero(ends)
        begin = np.concatenate([[0], last[:-1] + 1])  # first word of each sentence
        self.at = start[begin]
        self.first = np.searchsorted(begin, first)
        bound = np.append(begin, n)
        stop = np.maximum(np.arange(len(begin)) + sentences, np.searchsorted(bound, begin + least))
        limit = np.repeat(self.first[1:], np.diff(self.first))
        whole = stop <= limit
        stop = np.minimum(stop, len(begin))
        power, inverse = _power(n + 1)
        values = []
        for words_ in (h, mix(h + np.uint64(0x632BE59BD9B4E019))):
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(words_ * power[:n], out=sums[1:])
            values.append(mix((sums[bound[stop]] - sums[begin]) * inverse[begin] + (bound[stop] - begin).astype(np.uint64)))
        self.hash = np.where(whole, values[0].view(np.int64), 0)
        self.sure = np.where(whole, values[1] >> np.uint64(32), np.uint64(0)).astype(np.uint32).view(np.int32)
        self.run = np.where(whole, stop - np.arange(len(begin)), 0).astype(np.int32)

    def kept(self, k: int, places: list[int], runs: list[int]) -> tuple[str, int]:
        """Text ``k`` without the sentences covered, and their number."""
        a, b = self.first[k : k + 2]
        gone = np.zeros(b - a + 1, np.int64)
        np.add.at(gone, places, 1)
        np.add.at(gone, np.add(places, runs), -1)
        gone = np.cumsum(gone)[:-1] > 0
        at = self.at[a:b] - self.text_at[k]
        at[0] = 0
        edge = [*at.tolist(), len(self.raw[k])]
        return b"".join(self.raw[k][edge[j] : edge[j + 1]] for j in np.flatnonzero(~gone).tolist()).decode(), int(gone.sum())


def dedup(df: DataFrame, key: str = "doc_id", text: str = "text", sentences: int = 2, min_words: int = 12, long_words: int = 15, carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, text, n_sentences, n_removed`` for every row, the text without its repeated sentences; after them the
    columns named in ``carry``."""
    rows = common.text_rows(df, key, text).withColumn("mark", F.hash("text"))

    def spans(batches):
        for batch in batches:
            for at, size in common.chunks(batch):
                part = batch.slice(at, size)
                cut = Cut(part.column(1).to_pylist(), sentences, min_words, long_words)
                offsets = pa.array(cut.first.astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in (cut.hash, cut.sure, cut.run)]
                yield pa.record_batch([part.column(0), part.column(2), *lists], ["doc_id", "mark", "hash", "sure", "run"])

    fields = common.schema(doc_id=common.LONG, mark=common.INT, hash=T.ArrayType(common.LONG), sure=T.ArrayType(common.INT), run=T.ArrayType(common.INT))
    table = common.materialize(rows.where("doc_id IS NOT NULL AND text IS NOT NULL").mapInArrow(common.trimmed(spans), fields), "spans")
    places = table.select("doc_id", "mark", F.posexplode(F.arrays_zip("hash", "sure", "run")).alias("at", "s")).select("s.hash", "s.sure", "doc_id", "mark", "at", "s.run").where("hash <> 0")
    here = F.struct("doc_id", "mark", "at", "sure")
    heads = places.groupBy("hash").agg(F.count(F.lit(1)).alias("m"), F.min(here).alias("head")).where("m > 1")
    heads = common.materialize(heads, "heads")
    total = table.agg(F.coalesce(F.sum(F.size("hash")), F.lit(0))).first()[0]
    is_hot = F.col("m") > max(HOT_LEAST, total // HOT_PART)
    hot, rest = F.broadcast(heads.where(is_hot)), heads.where(~is_hot)
    met = places.join(hot, "hash").unionByName(places.join(hot, "hash", "left_anti").join(rest, "hash"))
    later = met.where((here != F.col("head")) & (F.col("sure") == F.col("head.sure"))).select("doc_id", "mark", "at", "run").distinct()
    gone = common.materialize(later.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("at", "run")).alias("gone")), "gone")
    common.drop(table, heads)
    few = gone.agg(F.coalesce(F.sum(F.size("gone") + 1), F.lit(0))).first()[0] <= BROADCAST_PLACES
    along = df.select(*(F.col(f"`{name}`") for name in carry))
    own = [f"_{k}" for k in range(len(carry))]
    whole = df.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"), *(F.col(f"`{name}`").alias(x) for name, x in zip(carry, own, strict=True)))
    whole = whole.withColumn("mark", F.hash("text"))
    full = whole.join(F.broadcast(gone) if few else gone.hint("shuffle_merge"), ["doc_id", "mark"], "left").select("doc_id", "text", "gone.at", "gone.run", *own)

    def rebuild(batches):
        for batch in batches:
            for at, size in common.chunks(batch):
                part = batch.slice(at, size)
                texts = part.column(1).to_pylist()
                cut = Cut(texts, sentences, min_words, long_words)
                removed = [0] * len(texts)
                for k, (places, runs) in enumerate(zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)):
                    if places:
                        texts[k], removed[k] = cut.kept(k, places, runs)
                yield pa.record_batch([part.column(0), pa.array(texts, pa.string()), pa.array(np.diff(cut.first)), pa.array(removed, pa.int64()), *part.columns[4:]], ["doc_id", "text", "n_sentences", "n_removed", *carry])

    fields = common.schema(doc_id=common.LONG, text=common.STR, n_sentences=common.LONG, n_removed=common.LONG)
    return full.mapInArrow(common.trimmed(rebuild), T.StructType([*fields.fields, *along.schema.fields]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without repeated sentences."""
    return dedup(common.table(spark, sf_dir, "documents"))
