"""Coercions and labels: blanks equal nulls, malformed numbers are 0, x / 0 is 0."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from mixlens import schema as S


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def text(x) -> Column:
    """Text without white space (Unicode's) at either end; null is blank."""
    return F.coalesce(F.regexp_replace(col(x).cast("string"), r"(?U)^[\s﻿]+|[\s﻿]+$", ""), F.lit(""))


def number(x, kind="decimal(18,2)") -> Column:
    """A number; what is no finite number is 0."""
    wide = F.expr(f"try_cast({x} as double)") if isinstance(x, str) else x.try_cast("double")
    exact = F.expr(f"try_cast({x} as {kind})") if isinstance(x, str) else x.try_cast(kind)
    finite = wide.isNotNull() & ~F.isnan(wide) & (F.abs(wide) < float("inf"))
    return F.when(finite, F.coalesce(exact, F.lit(0).cast(kind))).otherwise(F.lit(0).cast(kind))


def delimited(x) -> Column:
    """A comma-separated list, trimmed, without blanks, sorted."""
    parts = F.transform(F.split(text(x), ","), text)
    return F.array_join(F.array_sort(F.filter(parts, lambda p: p != "")), ", ")


def id_list(ids: Column) -> Column:
    return F.array_join(ids, ", ")


def rule_action(x) -> Column:
    """Blank means Map."""
    return F.when(text(x) == "", "Map").otherwise(text(x))


def semantic_key(action="rule_action", target="target_reporting_group_id") -> Column:
    """What a rule says, without its identity: source, scope, node, action, target."""
    kind = rule_action(action)
    return F.concat_ws("|", text("source_system_id"), text("scope_type"), text("node_id"), kind, F.when(kind == "Exclude", "").otherwise(text(target)))


def main_node_id(source, main) -> Column:
    return F.concat(col(source), F.lit(" || Main || "), col(main))


def hierarchy_level(scope, hierarchy=S.HIERARCHY) -> Column:
    """Level of a scope type; an unknown one is an error."""
    known = reduce(lambda acc, h: acc.when(col(scope) == h[0], h[1]), hierarchy[1:], F.when(col(scope) == hierarchy[0][0], hierarchy[0][1]))
    return known.otherwise(F.raise_error(F.concat(F.lit("unknown scope type "), F.coalesce(col(scope), F.lit("null")))).cast("int"))


def almost_equal(a, b) -> Column:
    """Within 1e-6, or within 1e-12 of the second."""
    a, b = col(a).cast("double"), col(b).cast("double")
    return F.abs(a - b) <= F.greatest(F.lit(1e-6), F.abs(b) * 1e-12)


def share(part, whole) -> Column:
    """A ratio; 0 where the whole is 0."""
    part, whole = col(part).cast("double"), col(whole).cast("double")
    return F.when(F.coalesce(whole, F.lit(0.0)) == 0, F.lit(0.0)).otherwise(F.coalesce(part, F.lit(0.0)) / whole)


def serial_date(x) -> Column:
    """The date of a spreadsheet serial day; 0 and null are open."""
    day = col(x).cast("int")
    return F.when(F.coalesce(day, F.lit(0)) != 0, F.date_add(F.lit("1970-01-01").cast("date"), day - 25569))


def date_serial(x) -> Column:
    return F.datediff(col(x), F.lit("1970-01-01").cast("date")) + 25569


def days(start="period_start", end="period_end") -> Column:
    return F.datediff(col(end), col(start)) + 1


def period_label(start="period_start", end="period_end", week=None, year=None) -> Column:
    """``Week W YYYY``, ``YYYY full year``, or both dates."""
    start, end = col(start), col(end)
    full = (F.month(start) == 1) & (F.dayofmonth(start) == 1) & (F.month(end) == 12) & (F.dayofmonth(end) == 31) & (F.year(start) == F.year(end))
    dates = F.concat(F.date_format(start, "dd.MM.yyyy"), F.lit("–"), F.date_format(end, "dd.MM.yyyy"))
    label = F.when(full, F.concat(F.year(start).cast("string"), F.lit(" full year"))).otherwise(dates)
    if week is None:
        return label
    return F.when(F.coalesce(col(week), F.lit(0)) != 0, F.concat(F.lit("Week "), col(week).cast("string"), F.lit(" "), col(year).cast("string"))).otherwise(label)


def in_effect(as_of: Column, start="effective_from", end="effective_to") -> Column:
    """Inclusive at both ends; a null end is open."""
    return (col(start).isNull() | (col(start) <= as_of)) & (col(end).isNull() | (col(end) >= as_of))


def intervals_overlap(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    low, high = F.lit("0001-01-01").cast("date"), F.lit("9999-12-31").cast("date")
    return (F.coalesce(a1, low) <= F.coalesce(b2, high)) & (F.coalesce(b1, low) <= F.coalesce(a2, high))
