"""Readers: by name, bound by header, with the checks a read has to pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mixlens import schema as S
from mixlens.functions.scalar import days, number, period_label, rule_action, serial_date, text
from mixlens.operators.bridge import expanded


def table(spark: SparkSession, root: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """A table by name; a missing table or column is an error of the analyzer."""
    df = spark.read.parquet(f"{root}/{name}.parquet")
    return df.select(*columns) if columns else df


def literal(spark: SparkSession, rows: list[tuple], fields: T.StructType | str) -> DataFrame:
    """A relation of given rows, as SQL VALUES: the optimizer knows its size, so it is broadcast where it is joined."""
    fields = T.StructType.fromDDL(fields) if isinstance(fields, str) else fields
    if not rows:
        return spark.createDataFrame([], fields)

    def show(value) -> str:
        if value is None:
            return "NULL"
        if isinstance(value, str):
            return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
        return f"DATE '{value}'" if hasattr(value, "isoformat") else str(value)

    values = ", ".join("(" + ", ".join(map(show, row)) + ")" for row in rows)
    names = ", ".join(f"`{f.name}`" for f in fields)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({names})").select(*(F.col(f.name).cast(f.dataType) for f in fields))


def unique(df: DataFrame, key: str, what: str) -> DataFrame:
    """The rows of a dimension; a repeated key is an error when they are read."""
    many = F.count(F.lit(1)).over(Window.partitionBy(key)) > 1
    told = F.when(many, F.raise_error(F.concat(F.lit(f"{what} has "), F.col(key), F.lit(" twice"))).cast("string")).otherwise(F.col(key))
    return df.withColumn(key, told)


def pinned(df: DataFrame, most: int = 10_000) -> DataFrame:
    """A small derived dimension as a literal relation, so that what it is derived from is read once; beyond ``most`` rows it
    stays as it is."""
    rows = df.limit(most + 1).collect()
    return df if len(rows) > most else literal(df.sparkSession, [tuple(r) for r in rows], df.schema)


def reporting_groups(df: DataFrame) -> DataFrame:
    """Groups with an id, none twice; sort order 999999 where blank."""
    df = unique(df, "reporting_group_id", "the group table")
    order = F.coalesce(F.nullif(F.col("sort_order").cast("int"), F.lit(0)), F.lit(999999))
    return df.select(text("reporting_group_id").alias("reporting_group_id"), text("reporting_group_name").alias("reporting_group_name"), text("active").alias("active"), order.alias("sort_order")).where("reporting_group_id <> ''")


def mapping_rules(df: DataFrame) -> DataFrame:
    """Rules with an id; blank action Map, and null, 0 or blank ends open.  Missing columns are added."""
    have = set(df.columns)
    dates = {c: F.col(c) if dict(df.dtypes)[c] == "date" else serial_date(F.expr(f"try_cast({c} as int)")) for c in ("effective_from", "effective_to")}
    return df.select(
        *(text(c).alias(c) for c in ("mapping_rule_id", "source_system_id", "scope_type", "node_id", "target_reporting_group_id")),
        (rule_action("rule_action") if "rule_action" in have else F.lit("Map")).alias("rule_action"),
        *(v.alias(c) for c, v in dates.items()),
        text("status").alias("status"),
        (F.col("seq") if "seq" in have else F.lit(0)).cast("int").alias("seq"),
    ).where("mapping_rule_id <> ''")


def active_imports(imports: DataFrame) -> DataFrame:
    """Active finalized imports, none twice, with label and days; a week's number and year, where there are such columns,
    make its label."""
    kept = imports.where((F.trim("publication_state") == S.ACTIVE_FINALIZED) & (F.trim("active_version") == "Yes"))
    week = {"week": "reporting_week", "year": "reporting_year"} if "reporting_week" in imports.columns else {}
    return unique(kept, "import_id", "the import table").select("import_id", "period_start", "period_end", period_label(**week).alias("label"), days().alias("days"))


def visible_categories(df: DataFrame) -> DataFrame:
    """The categories a selector shows: with an id and visible; unnamed ones are Uncategorized, order 999999 where blank."""
    name = F.coalesce(F.nullif(text("category_name"), F.lit("")), F.lit("Uncategorized"))
    order = F.coalesce(F.nullif(F.col("sort_order").cast("int"), F.lit(0)), F.lit(999999))
    return df.where((text("category_id") != "") & (text("visible") == "Yes")).select(text("category_id").alias("category_id"), name.alias("category_name"), order.alias("sort_order"))


def effective_mapping(df: DataFrame) -> DataFrame:
    """A written mapping: its columns by name, rows with a product."""
    return df.where(F.coalesce("product_id", F.lit("")) != "").select(*S.EFFECTIVE)


def bridge(df: DataFrame, counted: bool = False) -> DataFrame:
    """A written bridge: its columns by name, rows with an id; an import that a partition's name cannot tell is blank.  Rows written
    once with ``copies`` are given that often, but for ``counted``, which keeps the column."""
    own = [*S.BRIDGE, "copies"] if "copies" in df.columns else S.BRIDGE
    rows = df.where(F.coalesce("sales_fact_id", F.lit("")) != "").withColumn("import_id", F.coalesce("import_id", F.lit(""))).select(*own)
    return rows if counted else expanded(rows)


def reporting_restaurants(restaurants: DataFrame) -> DataFrame:
    """Active, enabled restaurants; the name is the display name, else the source's, else the id."""
    name = F.coalesce(F.nullif(text("display_name"), F.lit("")), F.nullif(text("source_name"), F.lit("")), F.col("restaurant_id"))
    return restaurants.where("status = 'Active' AND reporting_enabled = 'Yes'").select("restaurant_id", name.alias("restaurant_name"))


def equivalences(df: DataFrame) -> DataFrame:
    """Definitions of which any id is given."""
    kept = df.where((text("definition_id") != "") | (text("reporting_group_id") != "") | (text("legacy_category_id") != ""))
    return kept.select(*(text(c).alias(c) for c in ("definition_id", "reporting_group_id", "legacy_category_id", "comparison_status", "active")))


def category_ids(df: DataFrame) -> DataFrame:
    return df.select(text("legacy_category_id").alias("legacy_category_id")).where("legacy_category_id <> ''")


def facts(df: DataFrame) -> DataFrame:
    """Facts with text and number coercions; what is wrong with them is told by ``validation.fact_errors``."""
    plain = {"period_start", "period_end", "quantity", "sales_amount"}
    return df.select(*((number(c) if c in ("quantity", "sales_amount") else F.col(c) if c in plain else text(c)).alias(c) for c in S.FACTS))
