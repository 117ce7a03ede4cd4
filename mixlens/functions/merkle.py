"""Hash trees of tables: where two versions of a table differ is found from the top down.

A row belongs to the leaf that the first ``depth`` hex digits of its key's MD5 name.  A node holds the number of its rows and the sum of 60
bits of each row's MD5, so a parent is the sum of its sixteen children, partial trees add up, and order does not matter.  A tree
is one aggregation of the table; it can be stored, and compared without the table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_hash(columns: list[str]) -> Column:
    """60 bits of the MD5 of a row's columns as text."""
    text = F.concat_ws("|", *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("~")) for c in columns))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("decimal(38,0)")


def leaf(key: str, depth: int) -> Column:
    return F.substring(F.md5(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("~"))), 1, depth)


def tree(df: DataFrame, key: str, depth: int = 3) -> DataFrame:
    """``level, node, rows, content``: level 0 is the root (node blank), level ``depth`` the leaves that have rows."""
    leaves = df.select(leaf(key, depth).alias("node"), row_hash(df.columns).alias("h")).groupBy("node").agg(F.count(F.lit(1)).alias("rows"), F.sum("h").cast("decimal(38,0)").alias("content"))
    every = F.explode(F.array(*(F.struct(F.lit(k).alias("level"), F.substring("node", 1, k).alias("node")) for k in range(depth + 1))))
    up = leaves.select(every.alias("e"), "rows", "content").select("e.*", "rows", "content")
    return up.groupBy("level", "node").agg(F.sum("rows").alias("rows"), F.sum("content").cast("decimal(38,0)").alias("content"))


def changed_leaves(before: DataFrame, after: DataFrame, depth: int = 3) -> DataFrame:
    """``node, rows_before, rows_after`` of the leaves that differ: each level is compared only below nodes that differ."""
    open_ = None
    for k in range(depth + 1):
        a, b = (t.where(F.col("level") == k).select("node", F.col("rows").alias(f"rows_{n}"), F.col("content").alias(f"content_{n}")) for t, n in ((before, "before"), (after, "after")))
        if open_ is not None:
            parent = open_.select(F.col("node").alias("parent"))
            a, b = (t.withColumn("parent", F.substring("node", 1, k - 1)).join(parent, "parent", "left_semi").drop("parent") for t in (a, b))
        zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("rows_before", "rows_after")]
        both = a.join(b, "node", "full_outer").where(~(F.col("rows_before").eqNullSafe(F.col("rows_after")) & F.col("content_before").eqNullSafe(F.col("content_after"))))
        open_ = both.select("node", *zero)
    return open_


def changed_rows(before: DataFrame, after: DataFrame, key: str, leaves: DataFrame, depth: int = 3) -> DataFrame:
    """``key, kind`` (added, removed, changed) of the rows in these leaves; the others are not joined.  A key that several rows have
    is compared by their number and the sum of their hashes."""
    sides = []
    for df, n in ((before, "before"), (after, "after")):
        inside = df.withColumn("node", leaf(key, depth)).join(leaves.select("node"), "node", "left_semi")
        sides.append(inside.groupBy(F.col(f"`{key}`").alias("key")).agg(F.struct(F.count(F.lit(1)), F.sum(row_hash(df.columns))).alias(n)))
    both = reduce(lambda a, b: a.join(b, "key", "full_outer"), sides)
    kind = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(F.col("before") != F.col("after"), "changed")
    return both.select("key", kind.alias("kind")).where("kind IS NOT NULL")
