"""Best-fit packing of token sequences by bin completion with branch and bound.

Only the *lengths* matter to the search, and there are at most ``capacity`` of them, so the driver plans on a histogram
of bounded size whatever the number of pieces.  The first incumbent is best-fit decreasing.  Around the largest length
that is left the search enumerates undominated fillings, takes one as often as the counts allow (one pattern, many
sequences) and lets best fit complete what remains: every such completion that is better is the new incumbent.  While
the total is above the lower bound it branches over the other fillings; a branch ends when it wastes more than a better
total permits, or when what it has made and the lower bound of the rest cannot win.  So no plan has more sequences than
best fit; ``plan`` tells the lower bound too, and a gap that the limits of the search leave open is no secret.  The k-th
piece of a length then finds its sequence and offset in the plan by arithmetic: pieces are numbered by length with
counts per (length, bucket), so a length that a third of all pieces have is dealt over all buckets.

Null texts count as empty; every document, even an empty one, has the end token and so a piece.  Null keys and repeated
rows are packed like others.  An empty table gives an empty result.  Other columns of a document table are ignored.
"""

from __future__ import annotations

import logging
from array import array
from bisect import bisect_right
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mixlens.llm import common
from mixlens.llm.bpe import worker_transducer
from mixlens.llm.op5_bpe import vocabulary

#: Limits of the search, not of the data: fillings kept for a largest length, steps and items of branching to find them,
#: nodes visited, and completions by best fit tried.
FILLINGS, STEPS, DEPTH, NODES, COMPLETIONS = 6, 600, 10, 6000, 400

Pattern = tuple[tuple[tuple[int, int], ...], int]


def cut(df: DataFrame, vocab: Broadcast, capacity: int = 1024, end: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids``: each document's ids and its end token; a longer one in pieces of
    ``capacity``, of which the first may be shorter."""

    def run(batches):
        machine, tail = worker_transducer(vocab.value), array("I", [end]).tobytes()
        for keys, texts in common.text_batches(batches):
            rows = []
            for key_, packed in zip(keys, machine.encode_many(texts), strict=True):
                packed += tail
                n = len(packed) // 4
                ends = range(n % capacity or capacity, n + 1, capacity)
                rows += [(key_, k, max(0, e - capacity), e - max(0, e - capacity), packed[4 * max(0, e - capacity) : 4 * e]) for k, e in enumerate(ends)]
            columns = list(zip(*rows, strict=True))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    names, kinds = ["doc_id", "piece", "start", "length", "ids"], [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
    fields = common.schema(doc_id=common.LONG, piece=common.INT, start=common.LONG, length=common.LONG, ids=T.BinaryType())
    return common.text_rows(df, key, text).mapInArrow(common.trimmed(run), fields)


def dominates(big: tuple[int, ...], small: tuple[int, ...]) -> bool:
    """Whether the items of ``small`` fit, in groups, into those of ``big``: then ``big`` is never the worse filling."""
    if not small:
        return True
    tried = set()
    for k, room in enumerate(big):
        if room >= small[0] and room not in tried:
            tried.add(room)
            left = tuple(sorted((*big[:k], room - small[0], *big[k + 1 :]), reverse=True))
            if dominates(left, small[1:]):
                return True
    return False


def fillings(counts: list[int], sizes: list[int], room: int) -> list[tuple[int, ...]]:
    """Undominated fillings of ``room`` by the lengths at hand (ascending ``sizes``), least waste first."""
    exact = fill_small(counts, sizes, room)
    if exact is not None:
        return [exact]
    best: list[tuple[int, tuple[int, ...]]] = []
    supply, steps, total = [0], 0, 0
    for s in sizes:
        total += s * counts[s]
        supply.append(total)

    def keep(left: int, found: tuple[int, ...]) -> None:
        if not any(f == found or len(found) <= DEPTH >= len(f) and dominates(f, found) for _, f in best):
            best[:] = [(w, f) for w, f in best if not (len(found) <= DEPTH >= len(f) and dominates(found, f))]
            best.append((left, found))
            best.sort(key=lambda x: (x[0], len(x[1])))
            del best[FILLINGS:]

    def search(left: int, top: int, chosen: tuple[int, ...]) -> bool:
        """True when the search is to end."""
        nonlocal steps
        steps += 1
        leaf = True
        for k in range(bisect_right(sizes, min(left, top)) - 1, -1, -1):
            s = sizes[k]
            if len(best) == FILLINGS and left - supply[k + 1] >= best[-1][0]:
                break  # all that is left wastes as much as the worst filling kept
            if counts[s] <= chosen.count(s):
                continue
            leaf = False
            if len(chosen) < DEPTH:
                if search(left - s, s, (*chosen, s)):
                    return True
            else:
                rest, more = left, list(chosen)
                for j in range(k, -1, -1):
                    m = min(rest // sizes[j], counts[sizes[j]] - chosen.count(sizes[j]))
                    more += [sizes[j]] * m
                    rest -= sizes[j] * m
                keep(rest, tuple(more))
                break
        if leaf:
            keep(left, chosen)
        return steps >= STEPS or len(best) == FILLINGS and not best[-1][0]

    search(room, room, ())
    return [f for _, f in best] or [()]


def fill_small(counts: list[int], sizes: list[int], room: int) -> tuple[int, ...] | None:
    """An exact filling of at most two items, which nothing else dominates; the one whose scarcer length is plentiest."""
    if not room:
        return ()
    if counts[room]:
        return (room,)
    pairs = [(min(counts[s], counts[room - s]) if s != room - s else counts[s] // 2, s) for s in sizes if s <= room - s]
    most = max(pairs, default=(0, 0))
    return (room - most[1], most[1]) if most[0] else None


def lower_bound(counts: list[int], capacity: int) -> int:
    """Sequences that any plan needs: the bound L2 of Martello and Toth, the volume and the large lengths among it."""
    n, size = np.array(counts, object), np.arange(capacity + 1)
    number, volume = (np.concatenate([[0], np.cumsum(x)]) for x in (n, n * size))
    half, most = capacity // 2, 0
    for least in range(half + 1):  # lengths above capacity - least stand alone, those below least count nothing
        top = capacity - least + 1
        alone, large = number[-1] - number[top], number[top] - number[half + 1]
        middle, free = volume[half + 1] - volume[least], large * capacity - (volume[top] - volume[half + 1])
        most = max(most, alone + large + max(0, -(-(middle - free) // capacity)))
    return int(most)


def best_fit(counts: list[int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing over a histogram: equal sequences are one entry, found by what room they leave."""
    open_: dict[int, list[tuple[tuple[tuple[int, int], ...], int]]] = {}
    rooms = 0  # a bit for each room that is left somewhere

    def put(room: int, items: tuple, n: int) -> None:
        nonlocal rooms
        if n:
            open_.setdefault(room, []).append((items, n))
            rooms |= 1 << room

    for s in range(capacity, 0, -1):
        c = counts[s]
        while c:
            if fit := rooms >> s:
                room = s + (fit & -fit).bit_length() - 1
                items, n = open_[room].pop()
                if not open_[room]:
                    rooms ^= 1 << room
            else:
                room, items, n = capacity, (), c
            per = room // s
            full = min(n, c // per)
            put(room - per * s, (*items, (s, per)), full)
            c, n = c - full * per, n - full
            if n and 0 < c < per:
                put(room - c * s, (*items, (s, c)), 1)
                c, n = 0, n - 1
            if items:
                put(room, items, n)
    return [x for entries in open_.values() for x in entries]


def plan(histogram: dict[int, int], capacity: int) -> tuple[list[Pattern], int]:
    """Patterns ((length, how many), ...) with the numbers of sequences made by each, and the lower bound.  Branches
    leave the first descent at one point more each, those that leave it least first."""
    start = [0] * (capacity + 1)
    for size, n in histogram.items():
        start[size] += n
    total, bound = sum(s * n for s, n in enumerate(start)), lower_bound(start, capacity)
    best = best_fit(start, capacity)
    best_n = sum(n for _, n in best)
    nodes = completions = turn = 0
    todo: list[tuple[int, int, dict[int, int]]] = [(0, 0, {})]
    while todo and best_n > bound and nodes < NODES:
        _, _, choices = heappop(todo)
        counts, patterns, made, waste, step = start.copy(), [], 0, 0, 0
        every = max(1, len(histogram) // 50)
        while best_n > bound and nodes < NODES:
            sizes = [s for s in range(1, capacity + 1) if counts[s]]
            if completions < COMPLETIONS and step % every == 0 or not sizes:
                completions += 1
                rest = best_fit(counts, capacity)
                if made + sum(n for _, n in rest) < best_n:
                    best, best_n = patterns + rest, made + sum(n for _, n in rest)
            if not sizes or step % every == 0 and made + lower_bound(counts, capacity) >= best_n:
                break
            nodes += 1
            largest = sizes[-1]
            counts[largest] -= 1
            options = fillings(counts, sizes if counts[largest] else sizes[:-1], capacity - largest)
            counts[largest] += 1
            if step > max(choices, default=-1):
                for k in range(1, len(options)):
                    turn += 1
                    heappush(todo, (len(choices) + k, turn, {**choices, step: k}))
            items: dict[int, int] = {}
            for s in (largest, *options[min(choices.get(step, 0), len(options) - 1)]):
                items[s] = items.get(s, 0) + 1
            copies = min(counts[s] // m for s, m in items.items())
            for s, m in items.items():
                counts[s] -= m * copies
            patterns.append((tuple(sorted(items.items(), reverse=True)), copies))
            made += copies
            waste += copies * (capacity - sum(s * m for s, m in items.items()))
            step += 1
            if waste > (best_n - 1) * capacity - total:
                break
    return best, bound


def segments(patterns: list[Pattern], capacity: int) -> dict[str, np.ndarray]:
    """The plan by length: from rank ``first`` on, ``per`` pieces a sequence from sequence ``base``, at ``offset``."""
    rows, used, base = [], [0] * (capacity + 1), 0
    for items, copies in patterns:
        offset = 0
        for s, m in items:
            rows.append((s, used[s], m, base, offset))
            used[s] += m * copies
            offset += s * m
        base += copies
    rows.sort()
    return dict(zip(("size", "first", "per", "base", "offset"), np.array(rows, np.int64).reshape(-1, 5).T, strict=True))


def pack(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """Add ``sequence_id, offset`` to a table of pieces with a ``length`` from 1 to ``capacity``.  ``pieces`` has to be
    a written table, as it is read twice; all other columns go along.  Rows are dealt by their place in the table's files, so
    exact copies spread as other rows do."""
    spark, own = pieces.sparkSession, pieces.columns
    buckets = max(common.partitions(spark), 1)
    place_of = F.xxhash64("_metadata.file_name", "_metadata.row_index")
    dealt = pieces.select(*own, place_of.alias("__h")).withColumn("__b", F.pmod("__h", F.lit(buckets)).cast("int"))
    counts = dealt.groupBy("length", "__b").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("length").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__at"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("__n").alias("n")).collect()}
    if any(not 1 <= s <= capacity for s in histogram):
        raise ValueError(f"a length is outside 1 to {capacity}")
    patterns, bound = plan(histogram, capacity)
    logging.getLogger(__name__).info("%d sequences, at least %d are needed", sum(n for _, n in patterns), bound)
    of = segments(patterns, capacity)
    key = of["size"] << 44 | of["first"]

    def place(batches):
        for batch in batches:
            length, rank = (np.asarray(batch.column(k)) for k in (batch.num_columns - 2, batch.num_columns - 1))
            at = np.searchsorted(key, length << 44 | rank, side="right") - 1
            turn, slot = np.divmod(rank - of["first"][at], of["per"][at])
            new = [pa.array(of["base"][at] + turn), pa.array(of["offset"][at] + slot * length)]
            yield pa.record_batch([*batch.columns[:-2], *new], [*own, "sequence_id", "offset"])

    order = Window.partitionBy("length", "__b").orderBy("__h", *own)
    ranked = dealt.withColumn("__r", F.row_number().over(order)).join(starts, ["length", "__b"])
    fields = T.StructType([*pieces.schema.fields, *common.schema(sequence_id=common.LONG, offset=common.LONG).fields])
    return ranked.select(*own, F.col("length").alias("__l"), (F.col("__r") - 1 + F.col("__at")).alias("__k")).mapInArrow(common.trimmed(place), fields)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 tokens."""
    return run(common.table(spark, sf_dir, "documents"))


def run(docs: DataFrame) -> DataFrame:
    vocab = vocabulary(docs.sparkSession, common.tokenizer_path("byte_bpe_50k.json"))
    pieces = cut(docs, vocab).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(common.materialize(pieces, "pieces"))
