"""N-gram Jaccard join by grouped prefixes, and the components of its links.

A document is its set of distinct word shingles.  Under one order of all shingles, two sets as alike as the threshold
asks share a shingle among the first ``n - ceil(t * n) + 1`` of each, and differ in size by the factor ``t`` at most.

1. Equal sets are one class.  Classes with the same prefix and size are one *group*; only groups enter the index.
2. The order puts shingles that many texts hold last, by powers of two of their number, then goes by the bytes of their
   words (long ones are rare), then by hash: all of it the shingle's own, so that equal sets have equal prefixes whatever their white space.  It decides
   the work, never the result, so what counts as frequent may be found a chunk at a time.
3. Group pairs, first pass: within a shingle and size band, each group meets only the leaders of its own band and of the
   two beside it, a leader being the group that holds the shingle with fewest rarer ones, and so lies nearest to the
   middle of its cluster.  Each class of a group meets its group's least.  The links that prove true already join most of
   a cluster.
4. Second pass: in each shingle, only components that are still apart meet (``meet``), by their shapes: the sizes and
   places that their groups have.  Of two sets the smaller must hold the shingle among its first 2t / (1 + t), so what
   holds it later only asks.  Shapes that fit are expanded to their groups, and a group stands for all its classes.
   Classes of one group that are still apart meet in the same way in what follows their common prefix (``beyond``).
5. Every candidate pair must pass a bound: two sets share no more than the sum over BINS hash bins of the smaller
   count.  What passes is verified on whole sets, recomputed from the texts of the documents concerned.

No pass emits all pairs of a group, and none is capped, so no link between different components is lost.

Null or blank texts, and null keys, have or take no links: their component is their own key.  Equal rows are one node; a
text is known by the least key that has it, so texts with the same least key are one node, and any other row follows its own
text.  Other columns are ignored.  An empty table gives none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mixlens.llm import common
from mixlens.llm.components import components
from mixlens.llm.shingles import fingerprint, mix, shingles

#: Shingles that so many texts of a chunk of so many characters hold, and so many in all, are ordered last, the most
#: frequent up to a bound on the broadcast.  A hint to the order alone.
CHUNK_LEAST, CHUNK_CHARS, FREQUENT_LEAST, FREQUENT_MOST = 2, 16_000_000, 6, 1_000_000
#: Shingles that many texts hold, ascending, and the powers of two of their numbers.
Often = tuple[np.ndarray, np.ndarray]
#: Characters hashed at a time.
HASHED = 1_000_000
#: Rows of a key column, and hashes, that may be broadcast.
BROADCAST_ROWS, BROADCAST_HASHES = 1_000_000, 4_000_000
#: A class of equal sets with more rows than all / HOT_PART, and than HOT_LEAST, is hot.
HOT_PART, HOT_LEAST = 100_000, 1000
#: Bins of the histogram of a set's hashes that bounds what two sets can share.
BINS = 256


def frequent(rows: DataFrame, k: int) -> Often:
    """Shingles that many different texts hold, as counted within chunks: only what occurs several times in a chunk is
    shuffled."""

    def run(batches):
        held: dict[tuple[int, int], np.ndarray] = {}
        size = 0

        def often():
            values, counts = np.unique(np.concatenate([np.zeros(0, np.int64), *held.values()]), return_counts=True)
            some = counts >= CHUNK_LEAST
            return pa.record_batch([pa.array(values[some]), pa.array(counts[some])], ["token", "n"])

        for _, texts in common.text_batches(batches, HASHED):
            held |= {fingerprint(f): f for f, _ in shingles(texts, k)}
            size += sum(len(t or "") for t in texts)
            if size >= CHUNK_CHARS:
                yield often()
                held, size = {}, 0
        yield often()

    size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    wide = rows.coalesce(max(rows.sparkSession.sparkContext.defaultParallelism, min(size // CHUNK_CHARS, 1 << 30)))  # small partitions count together
    parts = wide.mapInArrow(common.trimmed(run), common.schema(token=common.LONG, n=common.LONG))
    top = parts.groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT_LEAST)
    top = common.materialize(top, "frequent")
    kept = top.orderBy(F.desc("n"), "token").limit(FREQUENT_MOST) if top.count() > FREQUENT_MOST else top
    found = kept.select("token", F.log2("n").cast("tinyint").alias("c")).toArrow()
    token, number = np.asarray(found.column(0)), np.asarray(found.column(1))
    common.drop(top)
    order = np.argsort(token)
    return token[order], number[order]


def ordered(found: np.ndarray, span: np.ndarray, often: Often) -> np.ndarray:
    """The shingles of a set in the global order."""
    rank = -np.minimum(span, 1 << 30)
    if len(often[0]):
        at = np.minimum(np.searchsorted(often[0], found), len(often[0]) - 1)
        rank = rank + np.where(often[0][at] == found, often[1][at].astype(np.int64) + 1, 0) * (1 << 40)
    return found[np.argsort(rank, kind="stable")]


def prefix_length(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


def prefix_mark(prefix: np.ndarray) -> int:
    """64 bits of a prefix in its order."""
    h = mix(prefix.view(np.uint64) + np.uint64(7)) * (np.arange(len(prefix), dtype=np.uint64) * np.uint64(2) + np.uint64(1))
    return int(h.sum(dtype=np.uint64).view(np.int64))


def prefixes(rows: DataFrame, k: int, percent: int, often: Often) -> DataFrame:
    """``doc_id, n, fa, fb, pf, bins, prefix``: set size, set fingerprint, prefix fingerprint, counts of the set's hashes by
    bin (null if one is above 255), the prefix in order."""
    shared = rows.sparkSession.sparkContext.broadcast(often)

    def run(batches):
        last = shared.value
        for keys, texts in common.text_batches(batches, HASHED):
            rows_, bins_, firsts = [], [], []
            for found, span in shingles(texts, k):
                n = len(found)
                if not n:
                    rows_.append((0, 0, 0, 0))
                    bins_.append(None)
                    firsts.append(found)
                    continue
                prefix = ordered(found, span, last)[: prefix_length(n, percent)]
                bins = np.bincount(found & (BINS - 1), minlength=BINS)
                rows_.append((n, *fingerprint(found), prefix_mark(prefix)))
                bins_.append(bins.astype(np.uint8).tobytes() if bins.max() < 256 else None)
                firsts.append(prefix)
            ends = np.cumsum([0, *map(len, firsts)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(firsts)))
            yield pa.record_batch([pa.array(keys, pa.int64()), *(pa.array(c, pa.int64()) for c in zip(*rows_, strict=True)), pa.array(bins_, pa.binary()), lists], names)

    names = ["doc_id", "n", "fa", "fb", "pf", "bins", "prefix"]
    fields = common.schema(**dict.fromkeys(names[:5], common.LONG), bins=T.BinaryType(), prefix=T.ArrayType(common.LONG))
    return rows.mapInArrow(common.trimmed(run), fields)


def few(ids: DataFrame) -> DataFrame:
    """A written table of keys, to be broadcast if its size permits."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids


def possible(pairs: DataFrame, ids: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The pairs, of documents in ``ids``, whose bins leave room for enough shared shingles."""

    def run(batches):
        for batch in batches:
            n = np.asarray(batch.column(2)) + np.asarray(batch.column(3))
            keep = np.ones(batch.num_rows, bool)
            both = np.flatnonzero(np.asarray(batch.column(4).is_valid()) & np.asarray(batch.column(5).is_valid()))
            if len(both):
                x, y = (np.frombuffer(b"".join(batch.column(c).take(pa.array(both)).to_pylist()), np.uint8).reshape(-1, BINS) for c in (4, 5))
                keep[both] = (100 + percent) * np.minimum(x, y).sum(axis=1, dtype=np.int64) >= percent * n[both]
            yield pa.record_batch([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))], ["a", "b"])

    own = docs.join(few(ids), "doc_id", "left_semi").select("doc_id", "n", "fa", "fb", "bins").dropDuplicates(["doc_id", "n", "fa", "fb"])
    x, y = (own.select(F.col("doc_id").alias(i), F.col("n").alias(f"n{i}"), F.col("bins").alias(f"bins{i}")) for i in "ab")
    both = pairs.join(x, "a").join(y, "b").select("a", "b", "na", "nb", "binsa", "binsb")
    return both.mapInArrow(common.trimmed(run), common.schema(a=common.LONG, b=common.LONG))


def sets(rows: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """``doc_id, found``: whole sets of the documents in ``ids``."""

    def run(batches):
        for keys, texts in common.text_batches(batches, HASHED):
            found = [f for f, _ in shingles(texts, k)]
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            yield pa.record_batch([pa.array(keys, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found)))], ["doc_id", "found"])

    kept = rows.join(few(ids), "doc_id", "left_semi")
    return common.materialize(kept.mapInArrow(common.trimmed(run), common.schema(doc_id=common.LONG, found=T.ArrayType(common.LONG))), "sets")


def verify(pairs: DataFrame, docs: DataFrame, rows: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose whole sets are alike: 100 * intersection >= percent * union."""
    pairs = common.materialize(pairs.select("a", "b").where("a < b").distinct(), "pairs")
    ids = common.materialize(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "ids")
    pairs, old = common.materialize(possible(pairs, ids, docs, percent).distinct(), "possible"), pairs
    common.drop(old, ids)
    ids = common.materialize(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "ids")
    whole = sets(rows, ids, k)
    left, right = whole.select(F.col("doc_id").alias("a"), F.col("found").alias("x")), whole.select(F.col("doc_id").alias("b"), F.col("found").alias("y"))
    both = pairs.join(left, "a").join(right, "b")
    common_n = F.size(F.array_intersect("x", "y"))
    good = 100 * common_n >= percent * (F.size("x") + F.size("y") - common_n)
    links = common.materialize(both.where(good).select("a", "b").distinct(), "links")
    common.drop(pairs, ids, whole)
    return links


def shared_index(heads: DataFrame) -> DataFrame:
    """``g, n, at, token`` of the prefix shingles that two groups or more hold in their prefixes; ``at`` is the shingle's place in
    the order.  Of two sets that share a shingle at places (at, at2) and none before, no more than the shorter rest is
    shared.  A shingle that no other prefix holds may still lie behind another set's prefix, so only the place counts.  The
    shared ones' hashes are broadcast as far as the bound permits; beyond it the index is joined with them."""
    tokens = heads.select(F.explode("prefix").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("m"))
    tokens = common.materialize(tokens.where("m > 1").select("token"), "tokens")
    if tokens.count() > BROADCAST_HASHES:  # the written hashes stay, as the join reads them
        return heads.select(F.col("doc_id").alias("g"), "n", F.posexplode("prefix").alias("at", "token")).join(tokens, "token").select("g", "n", "at", "token")
    known = heads.sparkSession.sparkContext.broadcast(np.sort(np.concatenate([np.zeros(0, np.int64), *(np.asarray(b.column(0)) for b in tokens.toArrow().to_batches())])))
    common.drop(tokens)

    def run(batches):
        last = known.value
        for batch in batches:
            lists = batch.column(2)
            values, offsets = np.asarray(lists.flatten()), np.asarray(lists.offsets) - lists.offsets[0].as_py()
            row = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            hit = np.flatnonzero(last[np.minimum(np.searchsorted(last, values), len(last) - 1)] == values) if len(last) else np.zeros(0, np.int64)
            row, at = row[hit], hit - offsets[row[hit]]
            yield pa.record_batch([pa.array(np.asarray(batch.column(c))[row]) for c in (0, 1)] + [pa.array(at.astype(np.int32)), pa.array(values[hit])], ["g", "n", "at", "token"])

    return heads.select("doc_id", "n", "prefix").mapInArrow(common.trimmed(run), common.schema(g=common.LONG, n=common.LONG, at=common.INT, token=common.LONG))


def beyond(rows: DataFrame, ids: DataFrame, k: int, percent: int, often: Often) -> DataFrame:
    """``g, n, at, token`` for the classes in ``ids`` of what follows their prefix, as far as two sets of that prefix and
    size must share some of it; the tokens are the prefix's own, the places count from the prefix on."""
    shared = rows.sparkSession.sparkContext.broadcast(often)

    def run(batches):
        for keys, texts in common.text_batches(batches, HASHED):
            out = [[np.zeros(0, np.int64)] for _ in names]
            for key, (found, span) in zip(keys, shingles(texts, k), strict=True):
                n = len(found)
                if n:
                    every, first = ordered(found, span, shared.value), prefix_length(n, percent)
                    rest = every[first : first + n * (100 - percent) // (100 + percent) + 1].view(np.uint64)
                    mark = np.array([prefix_mark(every[:first])], np.int64).view(np.uint64) + np.uint64(n)
                    for column, values in zip(out, (np.full(len(rest), key), np.full(len(rest), n), np.arange(len(rest)), mix(rest ^ mix(mark)).view(np.int64)), strict=True):
                        column.append(values)
            yield pa.record_batch([pa.array(np.concatenate(c), t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)], names)

    names = ["g", "n", "at", "token"]
    kept = rows.join(few(ids), "doc_id", "left_semi")
    return kept.mapInArrow(common.trimmed(run), common.schema(g=common.LONG, n=common.LONG, at=common.INT, token=common.LONG)).distinct()


def fits(percent: int, n: str, at: str, n2: str, at2: str) -> Column:
    """Whether two sets may be alike that first meet at places (at, at2): they share no more than the shorter rest."""
    n, at, n2, at2 = map(F.col, (n, at, n2, at2))
    room = F.least(n - at, n2 - at2)
    return (100 * F.least(n, n2) >= percent * F.greatest(n, n2)) & ((100 + percent) * room >= percent * (n + n2))


def band(percent: int) -> Column:
    """The band of a size: two that are alike lie in one or in neighbours (the half leaves room for rounding)."""
    return F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.5 / percent))).cast("int")


def meet(index: DataFrame, percent: int) -> DataFrame:
    """``g, k, g2, k2``: the pairs of rows of ``index(token, g, n, at, k)`` that share a token, fit and are of different
    components ``k``.  Rows of one token, component, size and place are one shape; shapes meet before their rows do."""
    open_ = index.groupBy("token").agg(F.min("k").alias("lo"), F.max("k").alias("hi")).where("lo <> hi").select("token")
    rows = common.materialize(index.join(open_, "token").select("token", "n", "at", "k", "g").distinct(), "open")
    shape = rows.select("token", "n", "at", "k").distinct().withColumn("band", band(percent))
    small = shape.where(F.expr(f"{100 + percent} * (n - at) >= {2 * percent} * n")).withColumnsRenamed({"n": "n2", "at": "at2", "k": "k2"})
    large = shape.withColumn("band", F.explode(F.array(F.col("band"), F.col("band") - 1)))
    order = (F.col("n2") < F.col("n")) | ((F.col("n2") == F.col("n")) & (F.col("k2") < F.col("k")))
    both = large.join(small, ["token", "band"]).where(order & (F.col("k") != F.col("k2")) & fits(percent, "n", "at", "n2", "at2")).drop("band")
    other = rows.withColumnsRenamed({"n": "n2", "at": "at2", "k": "k2", "g": "g2"})
    found = both.join(rows, ["token", "n", "at", "k"]).join(other, ["token", "n2", "at2", "k2"]).select("g", "k", "g2", "k2").distinct()
    found = common.materialize(found, "met")
    common.drop(rows)
    return found


def marks(df: DataFrame, columns: tuple[str, ...], k: int, text: str = "text") -> DataFrame:
    """``columns`` of every row with ``n_shingles, fa, fb``: the size and fingerprint of its text's set."""
    own = df.select(*(F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(columns)), F.col(f"`{text}`").cast("string").alias("_text"))

    def run(batches):
        for batch in batches:
            for at, size in common.chunks(batch, HASHED, len(columns)):
                part = batch.slice(at, size)
                rows = [(len(f), *fingerprint(f)) if len(f) else (0, 0, 0) for f, _ in shingles(part.column(len(columns)).to_pylist(), k)]
                yield pa.record_batch([*part.columns[:-1], *(pa.array(c, pa.int64()) for c in zip(*rows, strict=True))], names)

    names = [*columns, "n_shingles", "fa", "fb"]
    return own.mapInArrow(common.trimmed(run), T.StructType([*df.select(*(F.col(f"`{c}`") for c in columns)).schema.fields, *common.schema(n_shingles=common.LONG, fa=common.LONG, fb=common.LONG).fields]))


def link(df: DataFrame, k: int = 4, percent: int = 85, key: str = "doc_id", text: str = "text", marked: bool = False) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row: documents link when 100 * intersection >= percent * union of
    their sets of ``k``-word shingles; ``marked``: also ``fa, fb``, the set's fingerprint."""
    rows = common.text_rows(df, key, text)
    known = rows.where("doc_id IS NOT NULL")
    often = frequent(rows, k)
    docs = common.materialize(prefixes(rows, k, percent, often), "prefixes")
    full = docs.where("n > 0 AND doc_id IS NOT NULL")

    # 1. classes of equal sets, groups of classes with one prefix and size
    classes = full.groupBy("n", "fa", "fb").agg(F.min(F.struct("doc_id", "pf")).alias("least"), F.count(F.lit(1)).alias("rows"))
    classes = classes.select("n", "fa", "fb", F.col("least.doc_id").alias("c"), F.col("least.pf").alias("pf"), "rows")
    classes = common.materialize(classes, "classes")
    groups = classes.groupBy("n", "pf").agg(F.min("c").alias("g"), F.count(F.lit(1)).alias("m"))
    member = common.materialize(classes.join(groups.where("m > 1"), ["n", "pf"]).select("g", "c"), "members")

    # 2. the index: a row for each shingle of a group's prefix that another group shares
    tails = full.select("doc_id", "n", "pf").join(groups.select(F.col("g").alias("doc_id"), "n", "pf"), ["doc_id", "n", "pf"], "left_anti")
    tails = common.materialize(tails.distinct(), "tails")
    heads = full.join(few(tails), ["doc_id", "n", "pf"], "left_anti")
    index = common.materialize(shared_index(heads).select("token", "g", "n", "at", band(percent).alias("band")).distinct(), "index")

    # 3. leaders
    lead = index.groupBy("token", "band").agg(F.min(F.struct("at", "g", "n")).alias("l"))
    around = lead.select("token", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"), F.col("l.g").alias("g2"), F.col("l.n").alias("n2"), F.col("l.at").alias("at2"))
    star = index.join(around, ["token", "band"]).where((F.col("g") != F.col("g2")) & fits(percent, "n", "at", "n2", "at2"))
    star = star.select(F.least("g", "g2").alias("a"), F.greatest("g", "g2").alias("b")).distinct()
    own = member.where("c <> g").select(F.least("g", "c").alias("a"), F.greatest("g", "c").alias("b"))
    links = verify(star.union(own), full, known, k, percent)
    part = components(links)

    # 4. components that are still apart, with all groups that hold a class of theirs
    inside = member.join(part.select(F.col("node").alias("c"), "component"), "c", "left").select("g", "c", F.coalesce("component", "c").alias("k"))
    inside = common.materialize(inside, "inside")
    alone = part.select(F.col("node").alias("g"), F.col("component").alias("k")).join(member.select("g"), "g", "left_anti")
    of = inside.select("g", "k").union(alone).distinct()  # the components of all classes of a group
    met = meet(index.join(of, "g", "left").select("token", "g", "n", "at", F.coalesce("k", "g").alias("k")), percent)
    x, y = (inside.select(F.col("g").alias(g), F.col("k").alias(k_), F.col("c").alias(c)) for g, k_, c in (("g", "k", "x"), ("g2", "k2", "y")))
    pairs = met.join(x, ["g", "k"], "left").join(y, ["g2", "k2"], "left").select(F.coalesce("x", "g").alias("x"), F.coalesce("y", "g2").alias("y"))
    split = inside.groupBy("g").agg(F.min("k").alias("lo"), F.max("k").alias("hi")).where("lo <> hi").select("g")
    split = common.materialize(inside.join(split, "g").select("c", "k"), "split")
    if not split.isEmpty():
        after = beyond(known, split.select(F.col("c").alias("doc_id")), k, percent, often).join(split.withColumnRenamed("c", "g"), "g")
        within = meet(after, percent)
        pairs = pairs.union(within.select(F.col("g").alias("x"), F.col("g2").alias("y")))
    pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    joined = pairs.join(links, ["a", "b"], "left_anti")
    more = verify(joined, full, known, k, percent)
    part = common.materialize(components(links.union(more)), "components")
    common.drop(index, tails, member, inside, split, met, links, more)

    # 5. every row gets its class's component
    final = classes.join(part.withColumnRenamed("node", "c"), "c", "left").select("n", "fa", "fb", "rows", F.coalesce("component", "c").alias("component"))
    final = common.materialize(final.groupBy("n", "fa", "fb").agg(F.min("component").alias("component"), F.max("rows").alias("rows")), "final")
    # classes above HOT_LEAST rows and all / HOT_PART, at most HOT_PART of them, never meet their rows in one task
    total = final.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    is_hot = F.col("rows") > max(HOT_LEAST, total // HOT_PART)
    hot, rest = F.broadcast(final.where(is_hot).drop("rows")), final.where(~is_hot).drop("rows")
    small, of = docs.select("doc_id", "n", "fa", "fb"), ["n", "fa", "fb"]
    out = small.join(hot, of).unionByName(small.join(hot, of, "left_anti").join(rest, of, "left").select(*of, "doc_id", "component"))
    keyed = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), keyed.alias("component_id"), *(["fa", "fb"] if marked else []))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents under four-word shingles at 85 %."""
    return link(common.table(spark, sf_dir, "documents"))
