"""A refresh: read, resolve, join, validate, and only then replace the outputs."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mixlens import schema as S
from mixlens.functions.fingerprint import mapping_fingerprint, protected_snapshot
from mixlens.operators import kpi, mapping, sinks, validation
from mixlens.operators import bridge as bridges
from mixlens.sources import binding, scratch, tables


@dataclass
class Model:
    """The model's relations, none of them read yet."""

    facts: DataFrame
    products: DataFrame
    classifications: DataFrame
    rules: DataFrame
    groups: DataFrame
    restaurants: DataFrame
    import_rows: DataFrame
    as_of: dt.date
    read: dict[str, DataFrame] | None = None  # the tables that these are made from

    @classmethod
    def bind(cls, spark: SparkSession, root: str, as_of: dt.date = binding.AS_OF, by_product: bool = False) -> Model:
        return cls(
            binding.facts(spark, root, by_product=by_product), binding.products(spark, root), binding.classifications(spark, root), binding.rules(spark), binding.groups(spark),
            tables.reporting_restaurants(binding.restaurants(spark, root)), binding.imports(spark, root), as_of, binding.inputs(spark, root),
        )

    @cached_property
    def imports(self) -> DataFrame:
        """The active imports, derived once."""
        return tables.pinned(tables.active_imports(self.import_rows))

    def stored(self) -> Model:
        """The same model with its facts written once, for plans that read them several times: their joins run once."""
        return replace(self, facts=scratch.stored(self.facts, "facts"))

    @property
    def day(self):
        return F.lit(self.as_of)

    def nodes(self) -> DataFrame:
        return mapping.product_hierarchy(self.products, self.classifications)

    def effective(self) -> DataFrame:
        return mapping.resolve(self.nodes(), self.rules, self.groups, self.day)

    def shared(self) -> DataFrame:
        """``product_id, copies`` of the ids that several products have.  The ids of the order tables hold six digits, so parts from
        a million on share them (a million ids at most), and a fact of such an id has a bridge row for each of its products."""
        return self.products.groupBy("product_id").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")

    def bridge(self, fingerprint="") -> DataFrame:
        return bridges.metric_bridge(self.facts, self.effective(), fingerprint)

    def counted_bridge(self, fingerprint="") -> DataFrame:
        """The bridge with equal rows once, as ``copies``."""
        return bridges.counted_bridge(self.facts, mapping.decisions(self.nodes(), self.rules, self.groups, self.day), fingerprint)

    def shares(self, measure: str = "sales_amount", metric: str = S.SHARE_METRIC, identify: bool = False) -> DataFrame:
        return kpi.share_results(self.bridge(), self.imports, self.groups, self.restaurants, measure, metric, identify=identify)


def refresh(model: Model, out: str, shared: DataFrame | None = None) -> str:
    """Write mapping, bridge and results under ``out``, and give the mapping's fingerprint.  Each table is written beside the
    one there, read back and validated, and only then replaces it; the bridge reads the mapping just written, the results
    the bridge.  What was read (the tables the model is made from, where it names them) has to be the same before and after.
    With ``shared`` equal rows of the bridge are written once, with ``copies``; ``tables.bridge`` gives all.  A repeated product id is an error, but for those in
    ``shared`` (``Model.shared``), which have as many rows as it says."""
    spark = model.facts.sparkSession
    inputs = {"facts": model.facts, "products": model.products, "classifications": model.classifications, "restaurants": model.restaurants} if model.read is None else model.read
    inputs = {**inputs, "rules": model.rules, "groups": model.groups}
    before = tables.pinned(protected_snapshot(inputs))
    model = model.stored()  # the facts' own joins run once; the last check reads the inputs themselves again
    validation.raise_if_any(validation.every(mapping.rule_errors(model.rules), validation.hierarchy_errors(model.nodes(), shared), validation.fact_errors(model.facts)))
    effective = model.effective()
    sinks.write_validated(effective, f"{out}/effective_mapping", lambda made: validation.every(validation.mapping_errors(made, shared), validation.freshness_errors(effective, made, model.day)), S.EFFECTIVE)
    made = tables.effective_mapping(spark.read.schema(effective.schema).parquet(f"{out}/effective_mapping"))
    mark = mapping_fingerprint(made, model.rules, model.groups, model.day).first()[0]
    columns = [*S.BRIDGE] if shared is None else [*S.BRIDGE, "copies"]
    if shared is None:
        rows = bridges.metric_bridge(model.facts, made, mark, F.current_timestamp())
    else:
        rows = bridges.counted_bridge(model.facts, mapping.counted(made), mark, F.current_timestamp())
    many = model.facts.select("import_id").distinct().limit(sinks.FEW + 1).count() > sinks.FEW
    sinks.write_validated(rows, f"{out}/bridge", lambda written: validation.written_errors(model.facts, written, model.day, mark, shared), columns, partition_by=("import_id",), deal=many)
    written = tables.bridge(spark.read.schema(rows.schema).parquet(f"{out}/bridge"), counted=True)
    results = kpi.share_results(written, model.imports, model.groups, model.restaurants, calculated_at=F.current_timestamp())
    results = results.withColumn("mapping_fingerprint", F.lit(mark)).withColumn("mapping_as_of_date", model.day)
    sinks.write_validated(results, f"{out}/metric_results", lambda stored: validation.result_errors(results, stored), S.RESULTS)
    validation.raise_if_any(changed_tables(before, protected_snapshot(inputs)))
    return mark


def differing(before: DataFrame, after: DataFrame) -> DataFrame:
    """``table_name`` of the tables whose rows or content are not as they were."""
    new = after.withColumnsRenamed({"rows": "rows_after", "content": "content_after"})
    return before.join(new, "table_name").where((F.col("rows") != F.col("rows_after")) | (F.col("content") != F.col("content_after"))).select("table_name")


def changed_tables(before: DataFrame, after: DataFrame) -> DataFrame:
    """Errors for these tables."""
    return validation.error(differing(before, after), "protected-table", "table_name", "changed meanwhile")
