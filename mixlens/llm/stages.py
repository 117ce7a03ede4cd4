"""Stages of the corpus pipeline: quality rules, language ID, near duplicates, repeated passages, packing.

Each stage takes and gives the columns of ``documents`` (the last gives packed pieces); other columns are dropped, whatever
their names.  Each works on all rows of its input: null keys, null and empty texts and repeated rows have the result that
the stage's operator states; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mixlens.llm import common, op1_quality, op2_packing, op8_substring, op9_langid, op10_jaccard

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Least score of a language ID that keeps a document: below, no language stands out at all.
LEAST_SCORE = 0.02

#: Tables that stages before the last have written for themselves.
_made: list[DataFrame] = []


def forget(spark: SparkSession) -> None:
    """Delete them; those of a session that has ended are left to its cluster."""
    common.drop(*(df for df in _made if df.sparkSession is spark))
    _made.clear()


def stage(function):
    """A stage whose own tables go when the next stage begins: its output has been written and read again by then."""

    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        forget(spark)
        with common.noting(_made):
            return function(spark, docs, sf_dir)

    return run_stage


@stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and resemble a language."""
    return op1_quality.kept_rows(docs, COLUMNS)


@stage
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language stands out; a missing label is filled in."""
    model = op9_langid.fit(op9_langid.labelled(docs))
    found = op9_langid.predict(docs, model, carry=("text", "lang", "source", "n_chars"))
    kept = found.where((F.col("lang_pred") != op9_langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component under five-word shingles at 80 %: the one with the smallest key; rows with that key
    are one if their texts are equal.  What has no shingle, or no key, is no one's duplicate and stays.

    Rows that share a key but not a text are told apart by the fingerprints of their sets, so one of them goes only for
    its own text."""
    found = op10_jaccard.link(docs, k=5, percent=80, marked=True)
    gone = common.materialize(found.where("component_id <> doc_id").select("doc_id", "n_shingles", "fa", "fb").distinct(), "gone")
    twice = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
    twice = common.materialize(twice, "twice")
    if twice.isEmpty():
        return docs.select(*COLUMNS).join(op10_jaccard.few(gone.select("doc_id")), "doc_id", "left_anti").select(*COLUMNS)
    single = docs.select(*COLUMNS).join(op10_jaccard.few(twice), "doc_id", "left_anti")
    single = single.join(op10_jaccard.few(gone.select("doc_id")), "doc_id", "left_anti").select(*COLUMNS)
    again = docs.select(*COLUMNS).join(op10_jaccard.few(twice), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    again = op10_jaccard.marks(again, COLUMNS, k=5).join(gone, ["doc_id", "n_shingles", "fa", "fb"], "left_anti").select(*COLUMNS)
    return single.unionByName(again)


@stage
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without sentences that repeat an earlier passage; those with nothing left go."""
    found = op8_substring.dedup(docs, carry=("lang", "source"))
    left = found.where(F.length(F.trim("text")) > 0)
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens with their sequences and offsets."""
    forget(spark)
    return op2_packing.run(docs)


STAGES = [
    ("quality", quality),
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = common.materialize(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
