"""Planned metrics: attach rate, parts of a share's change, NOK impact, trends and leaderboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mixlens import schema as S
from mixlens.functions.scalar import share
from mixlens.operators.kpi import COMPANY, RESTAURANT

#: Log2 of the registers of a sketch: 4096 registers, a standard error of 1.04 / sqrt(4096) = 1.6 %.
SKETCH_BITS = 12


def _kept(bridge: DataFrame, imports: DataFrame, restaurants: DataFrame) -> DataFrame:
    kept = bridge.where(F.col("publication_state") == S.ACTIVE_FINALIZED).join(imports.select("import_id"), "import_id", "left_semi")
    return kept.join(restaurants.select("restaurant_id"), "restaurant_id", "left_semi")


def _group() -> Column:
    return F.when(F.col("resolution_status") == S.MAPPED, F.col("effective_reporting_group_id")).otherwise("").alias("reporting_group_id")


def _places() -> Column:
    company = F.struct(F.lit(COMPANY).alias("scope_type"), F.lit("").alias("restaurant_id"))
    return F.explode(F.array(company, F.struct(F.lit(RESTAURANT).alias("scope_type"), F.col("restaurant_id").alias("restaurant_id")))).alias("p")


def basket_bitmaps(rows: DataFrame, basket: str = "basket_id") -> DataFrame:
    """``import_id, restaurant_id, reporting_group_id, bucket, bitmap``: exact sets of baskets, each bitmap 32,768 consecutive ids
    (4 KB).  They merge by ``bitmap_or_agg``, across scopes and across loads; basket ids are whole numbers, best without large gaps."""
    bucket, place = F.bitmap_bucket_number(F.col(basket)), F.bitmap_bit_position(F.col(basket))
    known = rows.where(F.col(basket).isNotNull()).select("import_id", "restaurant_id", _group(), bucket.alias("bucket"), place.alias("place"))
    return known.groupBy("import_id", "restaurant_id", "reporting_group_id", "bucket").agg(F.bitmap_construct_agg("place").alias("bitmap"))


def attach_rate(bridge: DataFrame, imports: DataFrame, groups: DataFrame, restaurants: DataFrame, basket: str = "basket_id") -> DataFrame:
    """Every import x active group x (company, each restaurant) with baskets: those that hold a mapped fact of the group over all.
    A basket may lie in several restaurants and groups, so no scope's number is the sum of others: the bitmaps of the smallest
    cells are merged to each scope, and counted after that.  A basket id that is null is no basket."""
    cells = basket_bitmaps(_kept(bridge, imports, restaurants), basket)
    scoped = cells.select("import_id", _places(), "reporting_group_id", "bucket", "bitmap").select("import_id", "p.*", "reporting_group_id", "bucket", "bitmap")
    keys = ["import_id", "scope_type", "restaurant_id"]
    by_group = scoped.where("reporting_group_id <> ''").groupBy(*keys, "reporting_group_id", "bucket").agg(F.bitmap_count(F.bitmap_or_agg("bitmap")).alias("n"))
    every = scoped.groupBy(*keys, "bucket").agg(F.bitmap_count(F.bitmap_or_agg("bitmap")).alias("n"))
    held = by_group.groupBy(*keys, "reporting_group_id").agg(F.sum("n").alias("group_baskets"))
    all_ = every.groupBy(*keys).agg(F.sum("n").alias("baskets"))
    active = groups.where("active = 'Yes'").select("reporting_group_id")
    rows = all_.crossJoin(F.broadcast(active)).join(held, [*keys, "reporting_group_id"], "left").withColumn("group_baskets", F.coalesce("group_baskets", F.lit(0)))
    return rows.select(*keys, "reporting_group_id", "group_baskets", "baskets", share("group_baskets", "baskets").alias("attach_rate"))


def basket_sketches(bridge: DataFrame, imports: DataFrame, restaurants: DataFrame, basket: str = "basket_id") -> DataFrame:
    """The same cells as HyperLogLog sketches of at most 4 KB whatever the number of baskets, for ids with large gaps or of text."""
    rows = _kept(bridge, imports, restaurants).select("import_id", "restaurant_id", _group(), F.col(basket).alias("b"))
    return rows.groupBy("import_id", "restaurant_id", "reporting_group_id").agg(F.hll_sketch_agg("b", F.lit(SKETCH_BITS)).alias("sketch"))


def sketched_attach_rate(sketches: DataFrame) -> DataFrame:
    """Attach rates from merged sketches; each number of baskets has a standard error of 1.6 %."""
    keys = ["import_id", "scope_type", "restaurant_id"]
    scoped = sketches.select("import_id", _places(), "reporting_group_id", "sketch").select("import_id", "p.*", "reporting_group_id", "sketch")
    held = scoped.where("reporting_group_id <> ''").groupBy(*keys, "reporting_group_id").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("group_baskets"))
    every = scoped.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("baskets"))
    return held.join(every, keys).select(*keys, "reporting_group_id", "group_baskets", "baskets", share("group_baskets", "baskets").alias("attach_rate"))


#: Parts of shares are whole numbers of this unit, so that sums are exact.
UNIT = 10**12


def _cents(c: Column) -> Column:
    return (c * 100).cast("decimal(38,0)")


def _over(part: str, whole: str) -> str:
    """Units of a share, cut; 0 where the whole is 0."""
    return f"CASE WHEN {whole} = 0 THEN 0L ELSE ({part} * {UNIT}) div {whole} END"


def change_parts(results: DataFrame, chosen: DataFrame) -> DataFrame:
    """Why each group's company share changed from the comparison to the current import, by restaurant, in units of 1e-12 of share:

    * ``change``: what the restaurant's sales of the group are of the company's, now less then;
    * ``rate``: the part of it from the group's share within the restaurant, at the restaurant's mean weight in the company;
    * ``mix``: the rest, which is the part from the restaurant's weight.

    Parts of a group add up to the change of its share but for ``rounding`` (cut digits), which is told once a group by
    ``change_summary``; all sums are exact."""
    both = results.join(F.broadcast(chosen), (F.col("import_id") == F.col("current_import")) | (F.col("import_id") == F.col("comparison_import")))
    zero = F.lit(0).cast("decimal(38,0)")
    at = lambda i, c: F.coalesce(F.max(F.when(F.col("import_id") == F.col(i), _cents(F.col(c)))), zero)
    keys = ["current_import", "comparison_import", "scope_type", "restaurant_id", "reporting_group_id"]
    by = both.groupBy(*keys).agg(at("current_import", "numerator").alias("n1"), at("comparison_import", "numerator").alias("n0"), at("current_import", "denominator").alias("d1"), at("comparison_import", "denominator").alias("d0"))
    company = by.where(F.col("scope_type") == COMPANY).select(*keys[:2], "reporting_group_id", F.col("d1").alias("t1"), F.col("d0").alias("t0"))
    rows = by.where(F.col("scope_type") == RESTAURANT).join(company, [*keys[:2], "reporting_group_id"])
    for name, part, whole in (("c1", "n1", "t1"), ("c0", "n0", "t0"), ("w1", "d1", "t1"), ("w0", "d0", "t0"), ("s1", "n1", "d1"), ("s0", "n0", "d0")):
        rows = rows.withColumn(name, F.expr(_over(part, whole)).cast("decimal(19,0)"))
    rate = F.expr(f"((w0 + w1) * (s1 - s0)) div {2 * UNIT}")
    rows = rows.withColumn("change", (F.col("c1") - F.col("c0")).cast("long")).withColumn("rate", rate)
    return rows.select(*keys[:2], "reporting_group_id", "restaurant_id", "change", "rate", (F.col("change") - F.col("rate")).alias("mix"))


def change_summary(results: DataFrame, chosen: DataFrame) -> DataFrame:
    """One row a group: change of the company's share = rate + mix + rounding, in units of 1e-12; and of its sales, in cents, the part
    from the change of share at today's total (``impact_cents``, the estimated NOK impact) and the rest, from the total itself
    (``volume_cents``)."""
    parts = change_parts(results, chosen).groupBy("current_import", "comparison_import", "reporting_group_id").agg(F.sum("rate").alias("rate"), F.sum("mix").alias("mix"))
    company = results.where(F.col("scope_type") == COMPANY)
    zero = F.lit(0).cast("decimal(38,0)")
    both = company.join(F.broadcast(chosen), (F.col("import_id") == F.col("current_import")) | (F.col("import_id") == F.col("comparison_import")))
    at = lambda i, c: F.coalesce(F.max(F.when(F.col("import_id") == F.col(i), _cents(F.col(c)))), zero)
    by = both.groupBy("current_import", "comparison_import", "reporting_group_id").agg(at("current_import", "numerator").alias("n1"), at("comparison_import", "numerator").alias("n0"), at("current_import", "denominator").alias("d1"), at("comparison_import", "denominator").alias("d0"))
    rows = by.withColumn("change", F.expr(f"{_over('n1', 'd1')} - {_over('n0', 'd0')}")).withColumn("impact_cents", F.expr("CAST(n1 AS long) - CASE WHEN d0 = 0 THEN 0L ELSE (n0 * CAST(d1 AS decimal(19,0))) div d0 END"))
    rows = rows.join(parts, ["current_import", "comparison_import", "reporting_group_id"], "left").fillna(0, ["rate", "mix"])
    return rows.select(
        "current_import", "comparison_import", "reporting_group_id", "change", "rate", "mix", (F.col("change") - F.col("rate") - F.col("mix")).alias("rounding"),
        (F.col("n1") - F.col("n0")).cast("long").alias("change_cents"), "impact_cents", ((F.col("n1") - F.col("n0")).cast("long") - F.col("impact_cents")).alias("volume_cents"),
    )


def trend(bridge: DataFrame, restaurants: DataFrame, groups: DataFrame, day: str, days: int = 28) -> DataFrame:
    """Weekly shares of each restaurant and active group, over weeks (from Monday) in which the restaurant sold anything: the share over
    the last ``days`` days (a RANGE frame, so weeks without sales are no rows but still pass), the week before that had sales with
    its distance and share, and the place among restaurants in the week (equal shares have one rank)."""
    week = F.date_trunc("week", F.col(day)).cast("date").alias("week")
    rows = bridge.where(F.col("publication_state") == S.ACTIVE_FINALIZED).join(restaurants.select("restaurant_id"), "restaurant_id", "left_semi")
    cube = rows.where(F.col(day).isNotNull()).groupBy("restaurant_id", week, _group()).agg(F.sum("sales_amount").alias("s"))
    whole = cube.groupBy("restaurant_id", "week").agg(F.sum("s").cast(S.TOTAL).alias("all_sales"))
    active = groups.where("active = 'Yes'").select("reporting_group_id")
    grid = whole.crossJoin(F.broadcast(active)).join(cube, ["restaurant_id", "week", "reporting_group_id"], "left")
    grid = grid.withColumn("sales", F.coalesce("s", F.lit(0)).cast(S.TOTAL)).withColumn("_day", F.datediff("week", F.lit("1970-01-01").cast("date")))
    series = Window.partitionBy("restaurant_id", "reporting_group_id").orderBy("_day")
    recent = series.rangeBetween(1 - days, 0)
    grid = grid.withColumn("week_share", share("sales", "all_sales"))
    place = Window.partitionBy("week", "reporting_group_id").orderBy(F.desc("week_share"))
    return grid.select(
        "restaurant_id", "reporting_group_id", "week", "sales", "all_sales", "week_share",
        share(F.sum("sales").over(recent), F.sum("all_sales").over(recent)).alias("moving_share"), F.count(F.lit(1)).over(recent).alias("weeks_counted"),
        F.lag("week").over(series).alias("previous_week"), ((F.col("_day") - F.lag("_day").over(series)) / 7).cast("int").alias("weeks_since"),
        (F.col("week_share") - F.lag("week_share").over(series)).alias("change"), F.rank().over(place).alias("rank"), F.dense_rank().over(place).alias("dense_rank"),
    )
