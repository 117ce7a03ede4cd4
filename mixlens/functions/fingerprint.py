"""Identity: length-prefixed records and a pair of polynomial hashes, in column functions.

The hash of a text is two remainders, l = (l * 131 + c) mod 2147483647 and r = (r * 137 + c) mod 2147483629 over its UTF-16
code units and a line feed, as 16 hex digits (fixed values).  Over many records the polynomial is associative: a record
contributes its own remainder times a power of the base, so ranges of records are folded where they lie and only one pair
of (remainder, power) a range is combined.
"""

from __future__ import annotations

from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mixlens.functions.scalar import col, date_serial, delimited, text
from mixlens.sources import scratch

POLYNOMIALS = ((131, 2147483647), (137, 2147483629))
BLOCK = 1 << 16


def units(x) -> Column:
    """UTF-16 code units of a text as an array of longs."""
    hexed = F.hex(F.encode(col(x), "UTF-16BE"))
    n = (F.length(hexed) / 4).cast("int")
    return F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.conv(F.substr(hexed, i * 4 + 1, F.lit(4)), 16, 10).cast("long"))


def utf16_length(x) -> Column:
    return (F.octet_length(F.encode(col(x), "UTF-16BE")) / 2).cast("int")


def remainder(codes: Column, base: int, modulus: int) -> Column:
    return F.aggregate(codes, F.lit(0).cast("long"), lambda a, c: (a * base + c) % modulus)


def hex8(x: Column) -> Column:
    return F.lpad(F.lower(F.hex(x)), 8, "0")


def hash_text(x) -> Column:
    """16 hex digits of a text and a line feed."""
    codes = F.concat(units(x), F.array(F.lit(10).cast("long")))
    return F.concat(*(hex8(remainder(codes, b, m)) for b, m in POLYNOMIALS))


def record(kind: str, *fields) -> Column:
    """``KIND|len:value|...``; null is ``0:``."""
    parts = [F.concat(utf16_length(v).cast("string"), F.lit(":"), v) for v in (F.coalesce(col(f).cast("string"), F.lit("")) for f in fields)]
    return F.concat_ws("|", F.lit(kind), *parts)


def powers(base: int, exponents: np.ndarray, modulus: int) -> np.ndarray:
    """``base ** exponents % modulus`` for a modulus below 2^31, by squaring for all at once."""
    out, square, rest = np.ones(len(exponents), np.uint64), base % modulus, exponents.copy()
    while rest.any():
        odd = (rest & np.uint64(1)).astype(bool)
        out[odd] = out[odd] * np.uint64(square) % np.uint64(modulus)
        square, rest = square * square % modulus, rest >> np.uint64(1)
    return out


def fold_codes(codes: np.ndarray, own: list[int]) -> list[int]:
    """The remainders ``own``, one a polynomial, carried on over more UTF-16 code units."""
    for at in range(0, len(codes), BLOCK):  # a term is below 2^47, so a block's sum stays below 2^63
        block = codes[at : at + BLOCK].astype(np.uint64)
        n = len(block)
        sums = [int((block * p[BLOCK - n :]).sum()) for p in _falling()]
        own = [(h * pow(b, n, m) + s) % m for h, s, (b, m) in zip(own, sums, POLYNOMIALS, strict=True)]
    return own


@cache
def _falling() -> tuple[np.ndarray, ...]:
    """The powers of each base for the places of a block, the highest first."""
    return tuple(powers(b, np.arange(BLOCK - 1, -1, -1, dtype=np.uint64), m) for b, m in POLYNOMIALS)


def hash_records(records: DataFrame, prefix: str, column: str = "record") -> DataFrame:
    """One row ``fingerprint`` of a relation of texts: the hash of all, in code-unit order, each with a line feed.  Records
    are written once and dealt in ranges of their order; each range is folded to a remainder and the power of its length where
    it lies, a block of code units at a time, and only those few pairs meet."""
    rows = scratch.stored(records.select(F.col(column).alias("r")), "records")
    ranged = rows.repartitionByRange("r").sortWithinPartitions("r")

    def fold(batches):
        own, size = [0] * len(POLYNOMIALS), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                texts = batch.column(0).slice(at, 256).to_pylist()
                codes = np.frombuffer("".join(f"{t or ''}\n" for t in texts).encode("utf-16-be"), ">u2")
                own, size = fold_codes(codes, own), size + len(codes)
        if size:
            place = TaskContext.get().partitionId()
            yield pa.record_batch([pa.array([v], pa.int64()) for v in (place, *own, *(pow(b, size, m) for b, m in POLYNOMIALS))], ["i", "h0", "h1", "p0", "p1"])

    folded = ranged.mapInArrow(fold, "i long, h0 long, h1 long, p0 long, p1 long")
    ordered = folded.agg(F.array_sort(F.collect_list(F.struct("i", "h0", "h1", "p0", "p1"))).alias("all"))
    step = lambda k, m: lambda a, e: (a * e[f"p{k}"] + e[f"h{k}"]) % m
    folds = [F.aggregate("all", F.lit(0).cast("long"), step(k, m)) for k, (_, m) in enumerate(POLYNOMIALS)]
    return ordered.select(F.concat(F.lit(prefix), *map(hex8, folds)).alias("fingerprint"))


def mapping_fingerprint(effective: DataFrame, rules: DataFrame, groups: DataFrame, as_of: Column, version: str = "MIXLENS-MAPPING-V1") -> DataFrame:
    """Fingerprint of all that decides the mapping.  ``version`` names the semantics; a caller who must meet fingerprints
    made elsewhere gives that system's version text."""
    spark = effective.sparkSession
    v = spark.range(1).select(record("V", F.lit(version), date_serial(as_of)).alias("record"))
    g = groups.select(record("G", "reporting_group_id", "reporting_group_name", "active", "sort_order").alias("record"))
    r = rules.select(
        record("R", "mapping_rule_id", "source_system_id", "scope_type", "node_id", "rule_action", "target_reporting_group_id", date_serial("effective_from"), date_serial("effective_to"), "status").alias("record")
    )
    p = record("P", "product_id", "source_system_id", "main_node_id", "subcategory_node_id")
    signature = [
        "product_id",
        *(delimited(f"{level}_{kind}_id") for level in ("main_category", "subcategory", "product") for kind in ("rule", "target")),
        "effective_reporting_group_id", "effective_reporting_group_name", "resolution_source", "resolution_state", "resolution_status",
        delimited("winning_rule_id"), "main_node_id", "subcategory_node_id",
    ]
    own = effective.select(F.explode(F.array(p, record("E", *signature))).alias("record"))
    return hash_records(v.union(g).union(r).union(own), "MAP-")


def metric_result_id(restaurants: Column, metric="metric_id", channel: str = "All channels") -> Column:
    """Identity of a result: its key, for the company also the set of restaurants."""
    own = F.when(F.col("scope_type") == "Company", restaurants).otherwise("")
    return F.concat(
        F.lit("MRR-"),
        hash_text(F.concat_ws("|", text(metric), text("import_id"), text("reporting_group_id"), text("scope_type"), text("restaurant_id"), own, F.lit(channel), F.lit("Active Finalized"))),
    )


def restaurant_scope_fingerprint(restaurants: DataFrame) -> DataFrame:
    """One row ``restaurant_scope_fingerprint`` of the enabled restaurants (a small dimension)."""
    ids = restaurants.agg(F.array_sort(F.collect_list(text("restaurant_id"))).alias("ids"))
    serial = F.array_join(F.transform("ids", lambda i: F.concat(utf16_length(i).cast("string"), F.lit(":"), i)), "|")
    return ids.select(F.concat(F.lit("RSC-"), hash_text(F.concat(F.lit("ENABLED-RESTAURANTS|"), serial))).alias("restaurant_scope_fingerprint"))


def content_snapshot(df: DataFrame) -> DataFrame:
    """Rows and an order-independent hash of a table: the sum of 60 bits of each row's MD5."""
    text_ = F.concat_ws("|", *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("~")) for c in df.columns))
    part = F.conv(F.substring(F.md5(text_), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(part), F.lit(0)).cast("decimal(38,0)").alias("content"))


def protected_snapshot(tables: dict[str, DataFrame]) -> DataFrame:
    """``table_name, rows, content`` of several tables; compared before and after a refresh."""
    each = [content_snapshot(df).select(F.lit(name).alias("table_name"), "rows", F.col("content").cast("string").alias("content")) for name, df in tables.items()]
    return reduce(DataFrame.unionByName, each)


def boundary_snapshot(facts: DataFrame) -> DataFrame:
    """One row: how many facts, the least and greatest id, and the totals of all and of the finalized ones."""
    final = F.col("publication_state") == "Active Finalized"
    total = lambda c, only=None: F.coalesce(F.sum(c if only is None else F.when(only, F.col(c))), F.lit(0)).cast("decimal(38,2)")
    return facts.agg(
        F.count(F.lit(1)).alias("rows"), F.min(F.when(F.col("sales_fact_id") != "", F.col("sales_fact_id"))).alias("first_id"), F.max("sales_fact_id").alias("last_id"),
        total("sales_amount").alias("sales_nok"), total("quantity").alias("quantity"), total("sales_amount", final).alias("active_sales_nok"), total("quantity", final).alias("active_quantity"),
    )
