"""Intervals of days: which hold a day, which overlap.  Inclusive at both ends, a null end is open.

Nothing here compares all intervals of a key with one another.  Days meet intervals by equi-join on the key and a bucket of
``width`` days, with an exact check after; overlaps are found by a sweep with a running greatest end, itself dealt by key and
bucket, so a key that holds a large part of all rows is spread as its days are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mixlens.functions.scalar import in_effect
from mixlens.sources import scratch

LOW, HIGH = "0001-01-01", "9999-12-31"


def _bucket(day: Column, width: int) -> Column:
    return F.floor(F.datediff(day, F.lit("1970-01-01").cast("date")) / width).cast("int")


def extent(points: DataFrame, point: str) -> tuple[Column, Column]:
    """The first and last day of a relation, as scalar subqueries."""
    return points.agg(F.min(point)).scalar(), points.agg(F.max(point)).scalar()


def interval_join(points: DataFrame, intervals: DataFrame, on: list[str], point: str, start: str, end: str, width: int = 32, span: tuple[Column, Column] | None = None) -> DataFrame:
    """Each point with each interval of its key that holds it: all columns of both.  An interval is laid into the buckets it
    covers between the first and last day asked for (``span``; by default those of ``points``), a point into its own, so a point
    meets the intervals near it and no others."""
    low, high = span or extent(points, point)
    laid = intervals.withColumn("_low", F.greatest(F.coalesce(start, low), low)).withColumn("_high", F.least(F.coalesce(end, high), high)).where("_low <= _high")
    laid = laid.withColumn("_from", _bucket(F.col("_low"), width)).withColumn("_to", _bucket(F.col("_high"), width)).drop("_low", "_high")
    laid = laid.withColumn("_bucket", F.explode(F.sequence("_from", "_to"))).drop("_from", "_to")
    return points.withColumn("_bucket", _bucket(F.col(point), width)).join(laid, [*on, "_bucket"]).where(in_effect(F.col(point), start, end)).drop("_bucket")


def sweep(intervals: DataFrame, on: list[str], start: str, end: str, ident: str, width: int = 64) -> DataFrame:
    """The intervals with ``overlaps_earlier`` and ``overlaps_later`` (whether another of the key that begins earlier, or later,
    overlaps; equal starts go by ``ident``) and ``cluster_from``, the start of the chain of overlaps an interval is in.
    Intervals that end before they begin hold no day and are left out.  n log n: rows are sorted in their bucket, once and written, and what
    buckets before and after hold comes from one row a bucket."""
    s, e = F.coalesce(start, F.lit(LOW).cast("date")), F.coalesce(end, F.lit(HIGH).cast("date"))
    rows = intervals.withColumn("_s", s).withColumn("_e", e).where("_s <= _e").withColumn("_b", _bucket(F.col("_s"), width))
    own = Window.partitionBy(*on, "_b").orderBy("_s", ident)
    rows = scratch.stored(rows.withColumn("_end", F.max("_e").over(own.rowsBetween(Window.unboundedPreceding, -1))).withColumn("_next", F.lead("_s").over(own)), "sweep")
    over = Window.partitionBy(*on).orderBy("_b")
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy(*on, "_b").agg(F.max("_e").alias("_me"), F.min("_s").alias("_ms")).select(*on, "_b", F.max("_me").over(before).alias("_past"), F.lead("_ms").over(over).alias("_ahead"))
    rows = rows.join(ends, [*on, "_b"])
    rows = rows.withColumn("overlaps_earlier", F.coalesce(F.col("_s") <= F.greatest("_end", "_past"), F.lit(False)))
    rows = rows.withColumn("overlaps_later", F.coalesce(F.coalesce("_next", "_ahead") <= F.col("_e"), F.lit(False)))
    rows = rows.withColumn("_new", F.when(~F.col("overlaps_earlier"), F.col("_s")))
    rows = rows.withColumn("_in", F.max("_new").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    news = rows.groupBy(*on, "_b").agg(F.max("_new").alias("_mn")).select(*on, "_b", F.max("_mn").over(before).alias("_old"))
    rows = rows.join(news, [*on, "_b"]).withColumn("cluster_from", F.coalesce("_in", "_old"))
    return rows.select(*intervals.columns, "overlaps_earlier", "overlaps_later", F.nullif("cluster_from", F.lit(LOW).cast("date")).alias("cluster_from"))


def overlaps(intervals: DataFrame, on: list[str], start: str, end: str, ident: str, width: int = 32) -> DataFrame:
    """``on, a, b``: the idents of all pairs that overlap, ``a`` beginning first (equal starts by ident).  The sweep leaves only
    intervals that overlap some other; then each one's start is a point that meets the intervals that hold it, so the work follows
    the number of pairs there are."""
    held = scratch.stored(sweep(intervals, on, start, end, ident).where("overlaps_earlier OR overlaps_later").select(*on, ident, start, end), "overlapping")
    first = held.agg(F.date_sub(F.min(start), 1)).scalar()  # an open start lies before all others
    begun = F.coalesce(start, first, F.lit(LOW).cast("date"))
    points = held.select(*on, F.col(ident).alias("b"), begun.alias("_point"))
    other = held.select(*on, F.col(ident).alias("a"), begun.alias("_start"), F.col(end).alias("_end"))
    met = interval_join(points, other, on, "_point", "_start", "_end", width)
    return met.where("_start < _point OR (_start = _point AND a < b)").select(*on, "a", "b")
