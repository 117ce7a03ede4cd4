"""Metrics as rows: what is summed, over what, and by which member; all of them come from one aggregate of the facts.

A row has a measure, the column whose values are its members (blank: none), the values that columns must have for a fact to count in
the numerator, and the same for the denominator (null: no ratio).  ``compute`` reads the rows, groups the finalized facts once by every
column that any of them names, and makes all metrics, for the company and each restaurant, from that cube.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mixlens import schema as S
from mixlens.functions.scalar import share
from mixlens.operators.kpi import COMPANY, RESTAURANT

FIELDS = "metric_id string, measure string, member_column string, numerator map<string, array<string>>, denominator map<string, array<string>>"
MEASURES = {"sales_amount": F.sum, "quantity": F.sum, "fact_count": None}
MOST = 200


class MetricError(ValueError):
    """A metric row that cannot be computed."""


def definitions(spark, rows: list[tuple]) -> DataFrame:
    """A relation of metric rows."""
    return spark.createDataFrame(rows, FIELDS)


def _checked(rows: DataFrame, facts: DataFrame) -> list:
    found = rows.limit(MOST + 1).collect()
    if len(found) > MOST:
        raise MetricError(f"more than {MOST} metrics")
    ids = [r["metric_id"] for r in found]
    if len(set(ids)) < len(ids) or not all(ids):
        raise MetricError("metric ids are blank or not unique")
    for r in found:
        if r["measure"] not in MEASURES:
            raise MetricError(f"{r['metric_id']}: unknown measure {r['measure']}")
        for c in _columns(r):
            if c not in facts.columns:
                raise MetricError(f"{r['metric_id']}: unknown column {c}")
    return found


def _columns(row) -> list[str]:
    return [*([row["member_column"]] if row["member_column"] else []), *(row["numerator"] or {}), *(row["denominator"] or {})]


def _holds(values: dict[str, list[str]]) -> Column:
    return reduce(lambda a, c: a & F.coalesce(F.col(c[0]).isin(list(c[1])), F.lit(False)), sorted(values.items()), F.lit(True))


def compute(rows: DataFrame, bridge: DataFrame, imports: DataFrame, restaurants: DataFrame) -> DataFrame:
    """``metric_id, import_id, scope_type, restaurant_id, member, numerator, denominator, metric_value``: a row for each member with facts
    in the numerator or denominator; a metric without a denominator has its numerator as value."""
    found = _checked(rows, bridge)
    kept = bridge.where(F.col("publication_state") == S.ACTIVE_FINALIZED).join(imports.select("import_id"), "import_id", "left_semi").join(restaurants.select("restaurant_id"), "restaurant_id", "left_semi")
    columns = sorted({c for r in found for c in _columns(r)} - {"import_id", "restaurant_id"})
    sums = [F.sum(m).cast(S.TOTAL).alias(f"_{m}") for m in ("sales_amount", "quantity")] + [F.count(F.lit(1)).cast(S.TOTAL).alias("_fact_count")]
    cube = kept.groupBy("import_id", "restaurant_id", *columns).agg(*sums)
    each = []
    for r in found:
        value, none = F.col(f"_{r['measure']}"), F.lit(None).cast(S.TOTAL)
        member = F.coalesce(F.col(r["member_column"]).cast("string"), F.lit("")) if r["member_column"] else F.lit("")
        whole = none if r["denominator"] is None else F.when(_holds(r["denominator"]), value)
        each.append(F.struct(F.lit(r["metric_id"]).alias("metric_id"), member.alias("member"), F.when(_holds(r["numerator"] or {}), value).alias("n"), whole.alias("d"), F.lit(r["denominator"] is not None).alias("ratio")))
    place = F.array(F.struct(F.lit(COMPANY).alias("scope_type"), F.lit("").alias("restaurant_id")), F.struct(F.lit(RESTAURANT).alias("scope_type"), F.col("restaurant_id").alias("restaurant_id")))
    flat = cube.select("import_id", place.alias("places"), F.explode(F.array(*each)).alias("m")).where("m.n IS NOT NULL OR m.d IS NOT NULL")
    flat = flat.select("import_id", "m.*", F.explode("places").alias("p")).select("metric_id", "ratio", "import_id", "p.*", "member", "n", "d")
    keys = ["metric_id", "import_id", "scope_type", "restaurant_id"]
    small = flat.groupBy(*keys, "ratio", "member").agg(F.sum("n").cast(S.TOTAL).alias("n"), F.sum("d").cast(S.TOTAL).alias("d"))
    out = small.withColumn("whole", F.sum("d").over(Window.partitionBy(*keys)).cast(S.TOTAL)).where("n IS NOT NULL")
    zero = F.coalesce("whole", F.lit(0)).cast(S.TOTAL)
    return out.select(*keys, "member", F.col("n").alias("numerator"), F.when(F.col("ratio"), zero).alias("denominator"), F.when(F.col("ratio"), share("n", "whole")).otherwise(F.col("n").cast("double")).alias("metric_value"))
