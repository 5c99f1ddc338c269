"""From raw documents to packed sequences: quality, near-duplicates, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet and read again as the next one's docs.

All stages but the last return the columns of docs, in their order, whatever further columns there are and however they are
named. Null and empty texts are documents like others (good, alone, without personal data, of no words, of one id), null
sources are one source, null and repeated ids are rows like others, and an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.llm import minhash, mixing, packing, pii, quality
from tamis.llm.common import bounded_batches, materialize


#: Columns that stages read or change; others are set aside under names that no operator has.
CORE = ("doc_id", "text", "lang", "source", "n_chars")


def columns_aside(stage: Callable) -> Callable:
    """A stage that gives back every column of docs under its name, in its place, whatever it is called."""

    @wraps(stage)
    def run_aside(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        plain = [c if c in CORE else f"_column{k}" for k, c in enumerate(docs.columns)]
        return stage(spark, docs.toDF(*plain), sf_dir).select(*plain).toDF(*docs.columns)

    return run_aside


@columns_aside
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. A text without votes, so a null or empty one too, gets the score of
    such texts and stays where most are good; copies score alike."""
    bounded_batches(spark)
    return quality.score_documents(docs).where("keep").select(*docs.columns)


@columns_aside
def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays, the first one by doc_id (null last). Rows go by keys of their own, so
    repeated and null ids are rows like others. Null and empty texts are near to nothing and stay."""
    bounded_batches(spark)
    keyed = materialize(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    found = minhash.near_duplicates(keyed.select(F.col("_row").alias("doc_id"), "text"), words=5, percent=80)
    found = materialize(found.select(F.col("doc_id").alias("_row"), "component_id").join(keyed.select("_row", F.col("doc_id").cast("long").alias("id")), "_row"), "members")
    firsts = found.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "_row")).alias("first")).select("component_id", "first._row")
    # a component is named by its least row; where the first by doc_id is another one, the two change places
    moved = materialize(firsts.where("_row <> component_id"), "moved")
    copies = found.where("_row <> component_id").select("_row").join(moved.select("_row"), "_row", "left_anti").unionByName(moved.select(F.col("component_id").alias("_row")))
    return keyed.join(copies, "_row", "left_anti").select(*docs.columns)


@columns_aside
def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts is replaced by its kind, and n_chars is the new text's. Rows stay; null texts stay null."""
    bounded_batches(spark)
    return pii.find(docs, redact=True).select(*docs.columns)


@columns_aside
def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in target weights; a document may come twice, or be cut where the budget ends. Documents without words give
    nothing to a budget of words and aren't served."""
    bounded_batches(spark)
    return mixing.documents_mix(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences; a text without tokens has the id that ends a document."""
    bounded_batches(spark)
    return packing.pack_documents(docs.select("doc_id", "text"))


STAGES = [("quality", quality_stage), ("near-duplicates", near_duplicates_stage), ("pii", pii_stage), ("mixing", mixing_stage), ("packing", packing_stage)]
#: SQL can't express hashing, the trained models or the tokenizer; tests/llm hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


