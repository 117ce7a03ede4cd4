"""Prefix trie of conversations: partial tries of partitions, merged by node hash, then rolled up from the leaves.

1. A turn is the 128-bit hash of its role and text (``turns``); texts are read once and never shuffled.
2. Conversations are dealt by id and sorted; each task streams its own and keeps a small trie (``local_tries``): a node is the
   128-bit hash of its parent and its last turn, and so is the same everywhere.  It holds the smallest member, the number of
   members, and its ancestors 1, 2, 4, 8 ... levels above.  At NODES nodes the table is handed on and begun anew, within a
   conversation too, so the longest one needs no more than its path.
3. Node tables merge by hash: least member, sum of members (on the map side first, then by node).  A conversation's end goes
   into a list by node and id range of RANGE, so a list is bounded however many conversations end at one node.
4. Roll-up by doubling: after step k a node has the sums of all descendants less than 2^k levels below; the next step adds the
   sums of those exactly 2^k below.  So a trie of depth d takes log2(d) + 1 aggregations, each with map-side sums.
5. Children ask for their parent's columns by the split lookup of the hot-key join, as a parent may have a large part of all nodes.

The turns of one conversation pass one task as a stream that keeps 16 bytes a turn, and the ids of one node's ends one task as a
stream of their lists, as a SHA-256 is made in sequence.

Null roles and texts are empty; a null turn comes first; turns of one number go by the hash of role and text; repeated rows are
repeated turns.  Rows without a conversation id take no part.  Other columns are ignored.  An empty table gives no node, not even the root.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mixlens.llm import common
from mixlens.llm.op13_hotjoin import hot_keys, lookup

#: Nodes of a task's partial trie before it is handed on; ids a list of ends may span.
NODES, RANGE = 100_000, 4096
ROOT = bytes(16)


def turns(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, at, turn, chars`` of every row with an id: the turn's place, the hash of its role and text, its code points."""
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role, text))
    mark = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    rows = df.select(F.col(f"`{conv}`").cast("long").alias("conv_id"), F.col(f"`{turn}`").cast("long").alias("at"), mark.alias("turn"), F.length(text).cast("long").alias("chars"))
    return rows.where("conv_id IS NOT NULL")


def paths(rows: DataFrame) -> DataFrame:
    """Turns as paths, each conversation as it is: ``part`` 1 holds its turns, part 0 says that it is there."""
    there = rows.select("conv_id").distinct()
    return _parts(rows, there.select("conv_id", F.lit(None).cast("long").alias("at"), F.lit(None).cast("binary").alias("turn"), F.lit(None).cast("long").alias("chars")), F.lit(0))


def _parts(own: DataFrame, heads: DataFrame, skip: Column) -> DataFrame:
    first = heads.select("conv_id", F.lit(0).cast("byte").alias("part"), "at", "turn", "chars", F.lit(0).alias("skip"))
    return first.unionByName(own.select("conv_id", F.lit(1).cast("byte").alias("part"), "at", "turn", "chars", skip.cast("int").alias("skip")))


def rebuilt(rows: DataFrame, block: int = 100, most: int = 6) -> DataFrame:
    """Paths of rebuilt conversations: the first h turns of the block's first conversation, then a conversation's own turns after its
    first h; h is the CRC-32 of the id's digits modulo ``most``.  Of the blocks' first conversations the first most - 1 turns are
    gathered; all that ask for one are of its block."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("at"), "turn"))
    first = rows.where(F.col("conv_id") % block == 0).withColumn("_k", place).where(F.col("_k") < most)
    heads = first.groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(F.struct("_k", "turn", "chars"))).alias("heads"))
    asked = rows.select("conv_id").distinct().withColumn("base", F.col("conv_id") - F.col("conv_id") % block)
    none = F.array(F.struct(F.lit(0).alias("_k"), F.lit(None).cast("binary").alias("turn"), F.lit(None).cast("long").alias("chars")))
    given = asked.join(heads, "base", "left").select("conv_id", F.explode(F.concat(none, F.slice(F.coalesce("heads", F.slice(none, 1, 0)), F.lit(1), h))).alias("t"))
    return _parts(rows, given.select("conv_id", F.col("t._k").cast("long").alias("at"), "t.turn", "t.chars"), h)


_PARTIAL = common.schema(key=T.BinaryType(), depth=common.LONG, conv_id=common.LONG, n_convs=common.LONG, chars=common.LONG, up=T.ArrayType(T.BinaryType()), bucket=common.LONG, ids=T.ArrayType(common.LONG))


def local_tries(batches):
    """Partial node tables and lists of ends of sorted paths; rows with ``bucket`` are lists of ends."""
    nodes: dict[bytes, list] = {}
    ends: dict[tuple[bytes, int], list[int]] = {}
    conv, path, seen = None, bytearray(ROOT), 0  # a path is its nodes' hashes, end to end

    def at(depth):
        return bytes(path[16 * depth : 16 * depth + 16])

    def visit(key, chars):
        held = nodes.get(key)
        if held is None:
            depth = len(path) // 16 - 1
            nodes[key] = [depth, conv, 1, chars, [at(depth - (1 << k)) for k in range(depth.bit_length())]]
        else:
            held[1] = min(held[1], conv)
            held[2] += 1

    def end():
        if conv is not None:
            ends.setdefault((bytes(path[-16:]), conv // RANGE), []).append(conv)

    def handed():
        keys = list(nodes) + [k for k, _ in ends]
        rest = [None] * len(ends)
        columns = [list(c) + rest for c in zip(*nodes.values(), strict=True)] if nodes else [rest] * 5
        columns = [keys, *columns, [None] * len(nodes) + [b for _, b in ends], [None] * len(nodes) + [sorted(v) for v in ends.values()]]
        types = [pa.binary(), *[pa.int64()] * 4, pa.list_(pa.binary()), pa.int64(), pa.list_(pa.int64())]
        nodes.clear()
        ends.clear()
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], _PARTIAL.names)

    for batch in batches:
        for c, part, turn, chars, skip in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
            if c != conv:
                end()
                conv, path, seen = c, bytearray(ROOT), 0
                visit(ROOT, 0)
            if len(nodes) + len(ends) >= NODES:
                yield handed()
            if part:
                seen += 1
                if seen <= skip:
                    continue
            if turn is not None:
                key = hashlib.blake2b(path[-16:] + turn, digest_size=16).digest()
                path += key
                visit(key, chars)
    end()
    yield handed()


def merge(nodes: DataFrame) -> DataFrame:
    """One row a node of partial node tables; merging what is merged changes nothing."""
    return nodes.groupBy("key").agg(F.min("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.min("chars").alias("chars"), F.first("up").alias("up"))


def merge_ends(ends: DataFrame) -> DataFrame:
    """One ascending list for each node and id range."""
    return ends.groupBy("key", "bucket").agg(F.array_sort(F.flatten(F.collect_list("ids"))).alias("ids"))


def rolled(nodes: DataFrame) -> DataFrame:
    """The nodes with ``n_children, n_leaves, saved_tokens``."""
    kids = nodes.where("depth > 0").groupBy(F.get("up", F.lit(0)).alias("key")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = common.materialize(nodes.join(kids, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes")
    levels = nodes.agg(F.coalesce(F.max(F.size("up")), F.lit(0))).first()[0]
    sums = nodes.select("key", "up", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"))
    names = ("n_leaves", "saved_tokens")
    for k in range(levels):
        below = sums.where(F.size("up") > k).groupBy(F.get("up", F.lit(k)).alias("key")).agg(*(F.sum(c).alias(f"_{c}") for c in names))
        sums = common.materialize(sums.join(below, "key", "left").select("key", "up", *((F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in names)), "sums")
    return nodes.join(sums.drop("up"), "key")


def ends_hashes(ends: DataFrame) -> DataFrame:
    """``key, ends_sha256``: the hash of each node's ids, ascending, comma-joined; lists pass in their order."""

    def run(batches):
        key, state, out = None, None, []
        for batch in batches:
            for k, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = ",".join(map(str, np.asarray(ids.values).tolist()))
                if k != key:
                    if key is not None:
                        out.append((key, state.hexdigest()))
                    key, state = k, hashlib.sha256(text.encode())
                else:
                    state.update(b"," + text.encode())
            if len(out) > 10_000:
                yield pa.record_batch([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.string())], ["key", "ends_sha256"])
                out = []
        if key is not None:
            out.append((key, state.hexdigest()))
        yield pa.record_batch([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.string())], ["key", "ends_sha256"])

    dealt = ends.repartition("key").sortWithinPartitions("key", "bucket").select("key", "ids")
    return dealt.mapInArrow(run, common.schema(key=T.BinaryType(), ends_sha256=common.STR))


def trie(known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (``key, parent, turn's chars, depth, conv_id, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens``) and ends
    (``key, bucket, ids``) of paths."""
    dealt = known.repartition("conv_id").sortWithinPartitions("conv_id", "part", F.asc_nulls_first("at"), "turn")
    partial = common.materialize(dealt.select("conv_id", "part", "turn", "chars", "skip").mapInArrow(local_tries, _PARTIAL), "tries")
    ends = common.materialize(merge_ends(partial.where("bucket IS NOT NULL").select("key", "bucket", "ids")), "ends")
    nodes = common.materialize(rolled(merge(partial.where("bucket IS NULL"))), "trie")
    common.drop(partial)
    hot = hot_keys(nodes, "n_children", ["key"]).withColumnRenamed("key", "parent")
    above = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return lookup(nodes.withColumn("parent", F.get("up", F.lit(0))).drop("up"), above, hot, ["parent"]), ends


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all rebuilt conversations, a row a node."""
    nodes, ends = trie(rebuilt(common.materialize(turns(common.table(spark, sf_dir, "conversations")), "turns")))
    rows = nodes.join(ends_hashes(ends), "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)))
    return rows.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def oracle(crc32: str) -> str:
    """The same in DuckDB; ``crc32`` is the SQL of the checksum of ``CAST(c AS VARCHAR)``.  A path is the row of its turns' MD5."""
    return f"""
WITH t AS MATERIALIZED (
  SELECT conv_id AS c, turn, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS m, CAST(length(coalesce(text, '')) AS BIGINT) AS chars FROM conversations WHERE conv_id IS NOT NULL
),
o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, m) AS i FROM t),
ids AS MATERIALIZED (SELECT c, {crc32} % 6 AS h FROM (SELECT DISTINCT c FROM t)),
r AS (
  SELECT ids.c, 0 AS part, o.i, o.m, o.chars FROM ids JOIN o ON o.c = ids.c - ids.c % 100 AND o.i <= h
  UNION ALL SELECT o.c, 1, o.i, o.m, o.chars FROM o JOIN ids USING (c) WHERE o.i > h
),
d AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, i) AS depth, string_agg(m, '') OVER (PARTITION BY c ORDER BY part, i ROWS UNBOUNDED PRECEDING) AS path, chars FROM r),
p AS MATERIALIZED (SELECT c, depth, path, chars FROM d UNION ALL SELECT c, 0, '', 0 FROM ids),
n AS MATERIALIZED (SELECT path, depth, min(c) AS conv_id, count(*) AS n_convs, max(chars) AS chars FROM p GROUP BY 1, 2),
k AS MATERIALIZED (SELECT left(path, 32 * (depth - 1)) AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
s AS (SELECT left(path, 32 * a) AS path, sum(CASE WHEN coalesce(n_children, 0) = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * chars) AS saved_tokens
  FROM (SELECT n.*, n_children, unnest(range(0, depth + 1)) AS a FROM n LEFT JOIN k USING (path)) GROUP BY 1),
e AS (SELECT path, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c)) AS x FROM (SELECT c, arg_max(path, depth) AS path FROM p GROUP BY 1) GROUP BY 1)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, n.n_convs, CAST(coalesce(n_children, 0) AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, coalesce(x, sha256('')) AS ends_sha256
FROM n LEFT JOIN k USING (path) JOIN s USING (path) LEFT JOIN e USING (path) LEFT JOIN n u ON n.depth > 0 AND u.depth = n.depth - 1 AND u.path = left(n.path, 32 * (n.depth - 1))
"""
