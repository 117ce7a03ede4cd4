"""The approved migration decisions: one target a node, or the exclusion of a product."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mixlens import schema as S
from mixlens.sources.tables import literal

SOURCE = "SRC-TEST-SALES"
NOTE = "Approved business-definition migration; stable ID decision."

# Main categories, classifications and products with their groups, and the products left out.
MAIN_TARGETS = (
    ("*Bjørvika Special*", "RPG-0009"),
    ("Add-ons", "RPG-0001"),
    ("Alcoholic Drinks", "RPG-0003"),
    ("Bao Buns", "RPG-0009"),
    ("Bao Buns*", "RPG-0009"),
    ("Bao Buns.", "RPG-0009"),
    ("Beer*", "RPG-0005"),
    ("COCKTAILS*", "RPG-0003"),
    ("Campaign", "RPG-0009"),
    ("Campaign*", "RPG-0009"),
    ("Champagne", "RPG-0007"),
    ("Cider", "RPG-0005"),
    ("Cider*", "RPG-0005"),
    ("Classic Maki", "RPG-0009"),
    ("Classic Sushi*", "RPG-0009"),
    ("Cocktails", "RPG-0003"),
    ("Coctails", "RPG-0003"),
    ("Coffee & Tea", "RPG-0004"),
    ("Coffee & Tea*", "RPG-0004"),
    ("Coffee.", "RPG-0004"),
    ("Combinations", "RPG-0009"),
    ("Combinations*", "RPG-0009"),
    ("Deluxe Combination", "RPG-0009"),
    ("Deluxe Maki", "RPG-0009"),
    ("Deluxe Maki*", "RPG-0009"),
    ("Dessert", "RPG-0006"),
    ("Dirty Maki", "RPG-0009"),
    ("Dirty Maki*", "RPG-0009"),
    ("Drink Mix", "RPG-0003"),
    ("Drinks", "RPG-0002"),
    ("Extra", "RPG-0001"),
    ("Extras", "RPG-0001"),
    ("Fast Snacks", "RPG-0001"),
    ("Finish Line*", "RPG-0006"),
    ("Hot Food", "RPG-0009"),
    ("Kampanje", "RPG-0009"),
    ("Lunch Offer", "RPG-0009"),
    ("Lunch Specials*", "RPG-0009"),
    ("Main Courses*", "RPG-0009"),
    ("Mains", "RPG-0009"),
    ("Mocktail", "RPG-0002"),
    ("Mocktails", "RPG-0002"),
    ("Nigiri", "RPG-0009"),
    ("Poké Bowls", "RPG-0009"),
    ("Poké Bowls.", "RPG-0009"),
    ("Quick Drinks", "RPG-0005"),
    ("Sashimi", "RPG-0009"),
    ("Sauces", "RPG-0001"),
    ("Sauser", "RPG-0001"),
    ("Snacks", "RPG-0001"),
    ("Soft Drinks", "RPG-0002"),
    ("Softdrinks", "RPG-0002"),
    ("Softdrinks*", "RPG-0002"),
    ("Solheimsviken Special", "RPG-0009"),
    ("Special Wine", "RPG-0007"),
    ("Spirits", "RPG-0003"),
    ("Spirits*", "RPG-0003"),
    ("Starters", "RPG-0008"),
    ("Sushi", "RPG-0009"),
    ("Sushi + Hot Food", "RPG-0009"),
    ("Sushi Combinations", "RPG-0009"),
    ("Sushi For Many", "RPG-0009"),
    ("Sushi for One", "RPG-0009"),
    ("Sushi*", "RPG-0009"),
    ("Tilbud", "RPG-0009"),
    ("Upsell", "RPG-0001"),
    ("White Wine*", "RPG-0007"),
    ("Wine", "RPG-0007"),
    ("Wine & Bubbles*", "RPG-0007"),
    ("Wine & Sake", "RPG-0007"),
)
SUB_TARGETS = (
    ("SCL-00017", "RPG-0005"),
    ("SCL-00057", "RPG-0003"),
)
PRODUCT_TARGETS = (
    ("PRD-000035", "RPG-0005"),
    ("PRD-000133", "RPG-0004"),
    ("PRD-000222", "RPG-0007"),
    ("PRD-000223", "RPG-0007"),
    ("PRD-000238", "RPG-0009"),
    ("PRD-000239", "RPG-0009"),
    ("PRD-000286", "RPG-0006"),
    ("PRD-000287", "RPG-0009"),
    ("PRD-000288", "RPG-0009"),
    ("PRD-000289", "RPG-0009"),
    ("PRD-000290", "RPG-0008"),
    ("PRD-000319", "RPG-0009"),
    ("PRD-000328", "RPG-0008"),
    ("PRD-000329", "RPG-0008"),
    ("PRD-000337", "RPG-0003"),
    ("PRD-000338", "RPG-0003"),
    ("PRD-000369", "RPG-0009"),
    ("PRD-000370", "RPG-0009"),
    ("PRD-000374", "RPG-0002"),
    ("PRD-000458", "RPG-0005"),
    ("PRD-000462", "RPG-0005"),
    ("PRD-000479", "RPG-0009"),
    ("PRD-000494", "RPG-0005"),
    ("PRD-000507", "RPG-0005"),
    ("PRD-000536", "RPG-0005"),
    ("PRD-000537", "RPG-0005"),
    ("PRD-000556", "RPG-0009"),
    ("PRD-000557", "RPG-0009"),
    ("PRD-000626", "RPG-0009"),
    ("PRD-000655", "RPG-0007"),
    ("PRD-000672", "RPG-0007"),
    ("PRD-000673", "RPG-0007"),
    ("PRD-000680", "RPG-0002"),
    ("PRD-000682", "RPG-0002"),
    ("PRD-000690", "RPG-0001"),
    ("PRD-000710", "RPG-0007"),
    ("PRD-000711", "RPG-0007"),
    ("PRD-000789", "RPG-0009"),
    ("PRD-000827", "RPG-0002"),
    ("PRD-000871", "RPG-0009"),
    ("PRD-000879", "RPG-0001"),
    ("PRD-000920", "RPG-0007"),
    ("PRD-000925", "RPG-0007"),
    ("PRD-000932", "RPG-0009"),
    ("PRD-000953", "RPG-0003"),
    ("PRD-000956", "RPG-0003"),
    ("PRD-001008", "RPG-0007"),
    ("PRD-001012", "RPG-0002"),
    ("PRD-001013", "RPG-0002"),
)
EXCLUDED = (
    "PRD-000220",
    "PRD-000221",
    "PRD-000259",
    "PRD-000260",
    "PRD-000546",
    "PRD-000566",
    "PRD-000567",
    "PRD-000942",
)


def decisions(spark: SparkSession, source: str = SOURCE) -> DataFrame:
    """All decisions in order: ``seq``, node, action and target."""
    rows = [(S.MAIN, f"{source} || Main || {label}", "Map", group) for label, group in MAIN_TARGETS]
    rows += [(S.SUB, node, "Map", group) for node, group in SUB_TARGETS]
    rows += [(S.PRODUCT, node, "Map", group) for node, group in PRODUCT_TARGETS]
    rows += [(S.PRODUCT, node, "Exclude", "") for node in EXCLUDED]
    df = literal(spark, [(k, *r) for k, r in enumerate(rows)], "seq int, scope_type string, node_id string, rule_action string, target_reporting_group_id string")
    return df.withColumn("source_system_id", F.lit(source))
