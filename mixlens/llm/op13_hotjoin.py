"""Equi join of tables with hot keys: Bloom filters both ways, then an exact join in which hot keys are split.

1. Each side's keys make a Bloom filter (``bloom``): a table of ``words`` 64-bit words, a key setting four bits of one word.
   It is one aggregation by word with ``bit_or``, so partial filters merge on the map side, and filters of more data merge
   with ``merged``.  Its size is a parameter and never grows with the data; that table alone is broadcast.
2. A row whose key is null or not in the other side's filter surely has no partner.  It goes straight to the outer output
   and is never shuffled for the join.
3. What is left, false positives among it, is joined exactly.  A key that holds more than 1 / pieces of the surviving rows of
   a side is hot; there are at most ``pieces`` such keys a side.  Their rows are dealt over as many salts as the key has
   such parts, and meet copies of the other side's.  Joins are shuffle-hash joins.

``join`` returns the joined rows themselves.  ``partners`` gives each row of both tables the number of its partners and the
sum of a measure over them: the other side is reduced to one row a key first, with partial sums, so no pair is ever made.

Null keys match nothing.  Repeated rows all take part.  Empty tables are fine.  Columns of the right table that the left one has
too are renamed with ``_right`` (as often as needed).  Keys of both tables must have the same types.  Salts are dealt by the
row's place in its partition, so exact copies spread as well; the inputs have to be tables read from files or other plans
that give the same rows in the same order when a task is repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mixlens.llm import common

#: 64-bit words of a filter: 4 million bits, about 3 MB as a broadcast table whatever the input.  A key takes four bits, so
#: from about 500,000 keys on the filter lets more than a tenth of the others pass; results stay exact at any fill.
WORDS = 1 << 16


def _place(keys: list[Column], words: int) -> tuple[Column, Column]:
    """The word of a key, and its four bits in that word."""
    h = F.xxhash64(*keys)
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), (F.shiftrightunsigned(h, 24 + 6 * k) % 64).cast("int"))
    bits = bit(0)
    for k in range(1, 4):
        bits = bits.bitwiseOR(bit(k))
    return F.pmod(h, F.lit(words)), bits


def _known(keys: list[Column]) -> Column:
    known = keys[0].isNotNull()
    for k in keys[1:]:
        known = known & k.isNotNull()
    return known


def bloom(df: DataFrame, on: list[str], words: int = WORDS) -> DataFrame:
    """``word, bits`` of all keys of a table, a row for each of ``words`` words."""
    keys = [F.col(f"`{c}`") for c in on]
    word, bits = _place(keys, words)
    every = df.sparkSession.range(words).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))
    return merged(df.where(_known(keys)).select(word.alias("word"), bits.alias("bits")), every)


def merged(*filters: DataFrame) -> DataFrame:
    """One filter of several with the same number of words."""
    both = filters[0]
    for f in filters[1:]:
        both = both.unionByName(f)
    return both.groupBy("word").agg(F.bit_or("bits").alias("bits"))


def marked(df: DataFrame, on: list[str], other: DataFrame, words: int = WORDS) -> DataFrame:
    """The rows with ``_hit``: whether their key may be in the filter ``other``."""
    keys = [F.col(f"`{c}`") for c in on]
    word, bits = _place(keys, words)
    held = F.broadcast(other.select(F.col("word").alias("_word"), F.col("bits").alias("_held")))
    rows = df.withColumn("_at", word).join(held, F.col("_at") == F.col("_word"), "left")
    return rows.withColumn("_hit", _known(keys) & F.coalesce(F.col("_held").bitwiseAND(bits) == bits, F.lit(False))).drop("_at", "_word", "_held")


def both_ways(left: DataFrame, right: DataFrame, on: list[str], words: int = WORDS) -> tuple[DataFrame, DataFrame]:
    """Both tables with ``_hit``, each by the other's filter."""
    types = [[df.schema[c].dataType for c in on] for df in (left, right)]
    if types[0] != types[1]:
        raise ValueError(f"the keys have different types: {types[0]} and {types[1]}")
    return marked(left, on, bloom(right, on, words), words), marked(right, on, bloom(left, on, words), words)


def pieces(spark: SparkSession) -> int:
    """Parts of a side's rows above which a key is hot: four a shuffle partition."""
    return 4 * common.partitions(spark)


def _salt(n: str) -> Column:
    """A salt below column ``n`` (null: one salt), by the row's place."""
    return F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.coalesce(F.col(n), F.lit(1))).cast("int")


def _salts(n: str) -> Column:
    """All salts below column ``n``, one a row."""
    return F.explode(F.sequence(F.lit(0), F.coalesce(F.col(n), F.lit(1)) - 1))


def lookup(rows: DataFrame, table: DataFrame, hot: DataFrame, on: list[str]) -> DataFrame:
    """The rows with the other columns of a table that has one row a key (null where it has none).  ``hot``: ``_salts`` of the
    keys whose rows are dealt over so many parts, at most some thousands of keys; each part has a copy of the table's row."""
    asked = rows.join(F.broadcast(hot), on, "left").withColumn("_salt", _salt("_salts")).drop("_salts")
    dealt = table.join(F.broadcast(hot), on, "left").withColumn("_salt", _salts("_salts")).drop("_salts")
    return asked.join(dealt.hint("shuffle_hash"), [*on, "_salt"], "left").drop("_salt")


def hot_keys(counts: DataFrame, n: str, on: list[str]) -> DataFrame:
    """``on, _salts`` of the keys that hold more than 1 / pieces of all that column ``n`` counts."""
    part = max(counts.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0] // pieces(counts.sparkSession), 1)
    return counts.where(F.col(n) > part).select(*on, F.ceil(F.col(n) / part).cast("int").alias("_salts"))


def partners(left: DataFrame, right: DataFrame, on: list[str], measure: str, words: int = WORDS) -> tuple[DataFrame, DataFrame]:
    """Both tables, all rows and columns, with ``n`` (partners in the other table, long) and ``s`` (the sum of the others'
    ``measure``, 0 if there are none).  The tables must not have columns ``n``, ``s`` or those that begin with ``_``."""
    sides = both_ways(left, right, on, words)
    sums = [common.materialize(rows.where("_hit").groupBy(*on).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(measure), F.lit(0)).alias("s")), "keys") for rows in sides]
    out = []
    for rows, own, other in ((sides[0], *sums), (sides[1], *sums[::-1])):
        met = lookup(rows.where("_hit"), other, hot_keys(own, "n", on), on).select(*rows.columns, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("s", F.lit(0)).alias("s"))
        alone = rows.where("NOT _hit").withColumns({"n": F.lit(0).cast("long"), "s": F.lit(0).cast(other.schema["s"].dataType)})
        out.append(met.unionByName(alone).drop("_hit"))
    return out[0], out[1]


def _apart(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """The right table, its clashing columns renamed."""
    used = {c.lower() for c in [*left.columns, *right.columns]}
    new = {}
    for c in right.columns:
        if c not in on and c.lower() in {x.lower() for x in left.columns}:
            name = f"{c}_right"
            while name.lower() in used:
                name += "_right"
            used.add(name.lower())
            new[c] = name
    return right.withColumnsRenamed(new)


def join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", words: int = WORDS) -> DataFrame:
    """The rows of the inner, left, right or full join on equal columns ``on``: these, then the left table's other columns,
    then the right one's."""
    if how not in ("inner", "left", "right", "full"):
        raise ValueError(f"unknown join {how}")
    right = _apart(left, right, on)
    names = [*on, *(c for df in (left, right) for c in df.columns if c not in on)]
    l, r = both_ways(left, right, on, words)
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    keys = l.where("_hit").select(*on, one.alias("_l"), none.alias("_r")).unionByName(r.where("_hit").select(*on, none.alias("_l"), one.alias("_r")))
    counts = common.materialize(keys.groupBy(*on).agg(F.sum("_l").alias("_l"), F.sum("_r").alias("_r")), "counts")
    totals = counts.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("_l", "_r"))).first()
    a, b = (max(t // pieces(left.sparkSession), 1) for t in totals)
    is_hot = ((F.col("_l") > a) | (F.col("_r") > b)) & (F.col("_l") > 0) & (F.col("_r") > 0)
    hot = counts.where(is_hot).select(*on, F.ceil(F.col("_l") / a).cast("int").alias("_a"), F.ceil(F.col("_r") / b).cast("int").alias("_b"))
    # a row of a hot key lies in one row (or column) of its key's grid of cells, and is copied along it
    x = l.where("_hit").join(F.broadcast(hot), on).withColumn("_i", _salt("_a")).withColumn("_j", _salts("_b")).drop("_a", "_b", "_hit")
    y = r.where("_hit").join(F.broadcast(hot), on).withColumn("_j", _salt("_b")).withColumn("_i", _salts("_a")).drop("_a", "_b", "_hit")
    met = x.join(y.hint("shuffle_hash"), [*on, "_i", "_j"]).select(*names)
    rest = [rows.where("_hit").join(F.broadcast(hot.select(*on)), on, "left_anti").drop("_hit") for rows in (l, r)]
    met = met.unionByName(rest[0].join(rest[1].hint("shuffle_hash"), on, how).select(*names))
    for rows, hows in ((l, ("left", "full")), (r, ("right", "full"))):
        if how in hows:
            met = met.unionByName(rows.where("NOT _hit").drop("_hit"), allowMissingColumns=True)
    return met.select(*names)


def rekeyed(df: DataFrame, key: str, amount: str) -> DataFrame:
    """``id, client_id, crc`` of a shop's table: three tenths of the ids go to seven clients, by CRC-32 of the id's digits; ``crc``
    is that of ``id:cents`` (cents empty for an amount that is null or not finite)."""
    h = F.crc32(F.col(key).cast("string").cast("binary"))
    x = F.col(amount).cast("double")
    cents = F.when(~F.isnan(x) & (F.abs(x) < float("inf")), F.floor(100 * x + 0.5)).cast("string")
    own = F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(":"), F.coalesce(cents, F.lit("")))
    moved = F.when(h % 10 < 3, F.expr(f"(crc32(cast(cast(`{key}` AS string) AS binary)) div 10) % 7")).otherwise(F.col("client_id")).cast("long")
    return df.select(F.col(key).cast("long").alias("id"), moved.alias("client_id"), F.crc32(own.cast("binary")).alias("crc"))


def digest(clicks: DataFrame, sales: DataFrame) -> DataFrame:
    """One row per table and distinct id (null ids count as one): copies, rows of the three joins that hold them, and the sum
    of the partners' CRCs.  Copies of an id with different clients are added up under the least."""
    left, right = partners(clicks, sales, ["client_id"], "crc")
    rows = left.select(F.lit("click").alias("side"), "id", "client_id", "n", "s").unionByName(right.select(F.lit("sale").alias("side"), "id", "client_id", "n", "s"))
    alone = F.greatest(F.col("n"), F.lit(1))
    return rows.groupBy("side", "id").agg(
        F.min("client_id").alias("client_id"), F.count(F.lit(1)).alias("copies"), F.sum("n").alias("inner_rows"),
        F.sum(F.when(F.col("side") == "click", alone).otherwise(F.col("n"))).alias("left_rows"), F.sum(alone).alias("full_rows"), F.sum("s").alias("partner_crc"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks joined to sales on the client."""
    return digest(rekeyed(common.table(spark, sf_dir, "clicks"), "click_id", "value"), rekeyed(common.table(spark, sf_dir, "sales"), "sale_id", "total"))


def crc32(text: str) -> str:
    """CRC-32 of an ASCII text in DuckDB: nine steps a byte, one that takes it in and eight that shift."""
    steps = f"flatten(list_transform(string_split({text}, ''), lambda c: [ord(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {steps}), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295)"


ORACLE = f"""
WITH t AS (
  SELECT 'click' AS side, click_id AS id, client_id, value AS x FROM clicks UNION ALL SELECT 'sale', sale_id, client_id, total FROM sales
),
h AS (SELECT *, {crc32("CAST(id AS VARCHAR)")} AS h, id || ':' || coalesce(CAST(CAST(floor(100 * x + 0.5) AS BIGINT) AS VARCHAR), '') AS own FROM t),
r AS MATERIALIZED (SELECT side, id, CAST(CASE WHEN h % 10 < 3 THEN (h // 10) % 7 ELSE client_id END AS BIGINT) AS client_id, CAST({crc32("own")} AS BIGINT) AS crc FROM h),
k AS (SELECT side, client_id, count(*) AS n, sum(crc) AS s FROM r WHERE client_id IS NOT NULL GROUP BY 1, 2)
SELECT r.side, r.id, min(r.client_id) AS client_id, count(*) AS copies, CAST(coalesce(sum(k.n), 0) AS BIGINT) AS inner_rows,
  CAST(sum(CASE WHEN r.side = 'click' THEN greatest(coalesce(k.n, 0), 1) ELSE coalesce(k.n, 0) END) AS BIGINT) AS left_rows,
  CAST(sum(greatest(coalesce(k.n, 0), 1)) AS BIGINT) AS full_rows, CAST(coalesce(sum(k.s), 0) AS BIGINT) AS partner_crc
FROM r LEFT JOIN k ON k.client_id = r.client_id AND k.side <> r.side GROUP BY 1, 2
"""
