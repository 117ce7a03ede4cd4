"""Exact top-k inner products by an impact-ordered index, processed score at a time.

Components become integers, floor(scale * x).  In a block of vectors, each dimension's postings are sorted by component
and cut into segments, and a posting's impact is quantised to its segment's least and greatest.  For a query a segment's
level is the most it can change a score, in powers of two below the greatest; segments are processed level by level, the
highest first, each adding its bounds to the accumulators of its postings.  What the unread postings of a vector can still
change is bounded by their number times the greatest impact unread, and by the norms that query and vector have left
(Cauchy-Schwarz).  As soon as that proves that no more than a few vectors can be among the best k, processing stops and
the segments below stay unread; what may still be among the best is rescored exactly.

The queries (a stated set) are broadcast in parts of bounded size, and each part meets all vectors, block by block; a task
keeps the best k of what it has read, the parts' results are written one after the other to one table, so the plan stays
the same however many they are, and the tasks' best are merged by a ranked window.

Vectors that are null, or hold null or non-finite components, and null keys, take no part; vectors of another length
than a query's are no candidates of it; all-zero vectors are candidates like others.  Equal scores go to the smaller
key; a row never is its own candidate, nor is any row of the same key, and rows that repeat a key and vector count
once.  Fewer than k candidates give all.  Other columns are ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mixlens.llm import common

#: Vectors of an index block; bytes of a block of queries.
BLOCK, QUERY_BYTES = 4096, 32 << 20
#: Segments of a dimension's postings, levels of quantised impact, and the part of a block that is few enough to rescore.
SEGMENTS, LEVELS, ENOUGH = 64, 8, 6
#: Components beyond this are scored without the index, in whole numbers alone, as float64 might round their sums.
EXACT = 1 << 20


def top(keys: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best by score and then key; equal pairs count once."""
    order = np.lexsort((keys, -scores))
    keys, scores = keys[order], scores[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (scores[1:] != scores[:-1])
    at = np.flatnonzero(fresh)[:k]
    return keys[at], scores[at]


class Index:
    """A block's vectors of one length: each dimension's postings by component, and each segment's least and greatest."""

    def __init__(self, keys: np.ndarray, vectors: np.ndarray) -> None:
        _, self.whose = np.unique(keys, return_inverse=True)
        self.clash = len(keys) > 0 and int(self.whose.max()) + 1 < len(keys)
        if self.clash:  # rows that repeat a key and vector count once
            rows = np.unique(np.column_stack([keys, vectors]), axis=0)
            keys, vectors = rows[:, 0].copy(), rows[:, 1:].copy()
            _, self.whose = np.unique(keys, return_inverse=True)
            self.clash = int(self.whose.max()) + 1 < len(keys)
        self.keys, self.vectors = keys, vectors
        #: Postings processed and skipped so far.
        self.read = self.skipped = 0
        self.exact = not vectors.size or int(np.abs(vectors).max()) <= EXACT
        if not self.exact or not vectors.shape[1]:
            return
        order = np.argsort(vectors, axis=0, kind="stable")
        by_value = np.take_along_axis(vectors, order, axis=0)
        self.cuts = np.unique(np.linspace(0, len(keys), SEGMENTS + 1).astype(int))
        self.postings = np.ascontiguousarray(order.T.astype(np.int32))
        self.low, self.high = by_value[self.cuts[:-1]].T.astype(float), by_value[self.cuts[1:] - 1].T.astype(float)  # (width, segments)
        self.square = np.where(self.low * self.high > 0, np.minimum(np.abs(self.low), np.abs(self.high)), 0.0) ** 2
        self.norm = (vectors.astype(float) ** 2).sum(axis=1)

    def best(self, key: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys and scores of the k best, by score and then key."""
        could = np.arange(len(self.keys))
        if self.exact and query.size and len(self.keys) > 4 * k and np.abs(query).max() <= EXACT:
            could = self.possible(key, query.astype(float), k)
        could = could[self.keys[could] != key]
        scores = self.vectors[could] @ query
        return top(self.keys[could], scores, k)

    def possible(self, key: int, query: np.ndarray, k: int) -> np.ndarray:
        """Rows that no proof excludes."""
        used = np.flatnonzero(query)
        weight, n = query[used, None], len(self.keys)
        if not len(used):
            return np.arange(n)
        ends = weight * self.low[used], weight * self.high[used]
        most, least = np.maximum(*ends), np.minimum(*ends)
        impact = np.maximum(np.abs(most), np.abs(least))
        level = np.minimum(np.log2(max(impact.max(), 1.0) / np.maximum(impact, 1e-9)).astype(np.int64), LEVELS - 1)
        size, squares = np.diff(self.cuts), self.square[used]
        high, low, held, q2, v2 = np.zeros(n), np.zeros(n), np.zeros(n), np.full(n, float((query**2).sum())), self.norm.copy()
        other = self.keys != key
        could = np.arange(n)
        for now in range(LEVELS):
            which, part = np.nonzero(level == now)
            if len(which):
                # neighbouring segments of a dimension are one stretch of its postings
                first = np.flatnonzero((np.diff(which, prepend=-1) != 0) | (np.diff(part, prepend=-2) != 1))
                last = np.append(first[1:], len(which)) - 1
                rows = np.concatenate([self.postings[d, a:b] for d, a, b in zip(used[which[first]].tolist(), self.cuts[part[first]].tolist(), self.cuts[part[last] + 1].tolist(), strict=True)])
                many = size[part]
                for total, bound in ((high, most), (low, least), (q2, -np.broadcast_to(weight**2, most.shape)), (v2, -squares)):
                    total += np.bincount(rows, np.repeat(bound[which, part], many), n)
                held += np.bincount(rows, minlength=n)
                self.read += len(rows)
            if now < 2 and now < LEVELS - 1:
                continue  # too little is known for a proof
            left = np.minimum((len(used) - held) * np.where(level > now, impact, 0.0).max(), np.sqrt(np.maximum(q2, 0) * np.maximum(v2, 0)))
            own = (low - left)[other]
            if self.clash:  # a key with several vectors proves one place
                each = np.full(n, -np.inf)
                np.maximum.at(each, self.whose[other], own)
                own = each[each > -np.inf]
            if len(own) <= k:
                break
            could = np.flatnonzero(high + left >= np.partition(own, len(own) - k)[len(own) - k] - 0.5)
            if len(could) <= max(4 * k, n // ENOUGH):
                break
        self.skipped += int((size[None, :] * (level > now)).sum())
        return could


class Best:
    """The best k of each query so far."""

    def __init__(self, k: int) -> None:
        self.k, self.of = k, {}

    def add(self, key: int, keys: np.ndarray, scores: np.ndarray) -> None:
        if key in self.of:
            keys, scores = np.concatenate([self.of[key][0], keys]), np.concatenate([self.of[key][1], scores])
        self.of[key] = top(keys, scores, self.k)


def lists(batches) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (keys, vectors of one length)."""
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for batch in batches:
        keys, column = np.asarray(batch.column(0)), batch.column(1)
        offsets, values = np.asarray(column.offsets), np.asarray(column.values)
        width = np.diff(offsets)
        for w in np.unique(width).tolist():
            rows = np.flatnonzero(width == w)
            own = held.setdefault(w, [])
            own.append((keys[rows], values[offsets[:-1][rows][:, None] + np.arange(w)]))
            if sum(len(x) for x, _ in own) >= BLOCK:
                keys_, vectors = (np.concatenate(x) for x in zip(*own, strict=True))
                for at in range(0, len(keys_), BLOCK):
                    yield keys_[at : at + BLOCK], vectors[at : at + BLOCK]
                held[w] = []
    for own in held.values():
        if own:
            yield tuple(np.concatenate(x) for x in zip(*own, strict=True))


def whole_numbers(vector: Column, scale: float) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")))


def top_k(df: DataFrame, queries: Column, k: int = 10, scale: float = 1024.0, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score`` for the rows where ``queries`` (of the column ``id``) holds."""
    spark = df.sparkSession
    rows = df.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{vector}`").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    rows = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & F.coalesce(fine, F.lit(False)))
    rows = rows.select("id", whole_numbers(F.col("v"), scale).alias("v"))
    asked = rows.where(queries)
    size = asked.agg(F.coalesce(F.sum(F.size("v") * 8 + 16), F.lit(0))).first()[0]
    parts = -(-size // QUERY_BYTES)
    found = common.schema(query_id=common.LONG, vec_id=common.LONG, score=common.LONG)
    if not parts:
        return asked.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"), F.col("id").alias("score")).where("false")

    def best_of(part: int) -> DataFrame:
        some = asked.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == part).dropDuplicates(["id", "v"])
        table = some.toArrow()
        shared = spark.sparkContext.broadcast([(i, np.array(v, np.int64)) for i, v in zip(table.column(0).to_pylist(), table.column(1).to_pylist(), strict=True)])

        def run(batches):
            best = Best(k)
            for keys, vectors in lists(batches):
                index = Index(keys, vectors)
                for i, q in shared.value:
                    if len(q) == vectors.shape[1]:
                        best.add(i, *index.best(i, q, k))
            for i, (keys, scores) in best.of.items():
                yield pa.record_batch([pa.array(np.full(len(keys), i, np.int64)), pa.array(keys), pa.array(scores)], ["query_id", "vec_id", "score"])

        return rows.mapInArrow(run, found)

    every = best_of(0) if parts == 1 else common.materialize_parts(spark, found, map(best_of, range(parts)), "best")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = every.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of every vector whose id is divisible by 100, among all."""
    return top_k(common.table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)
