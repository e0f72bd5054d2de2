"""The stages that turn documents into packed training sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daygauge.llm import mixing, packing, quality, simhash, substrings
from daygauge.llm.common import identified, table, written
from daygauge.session import ship_package

#: A classifier has no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    ship_package(spark)
    return quality.score_quality(docs, table(spark, sf_dir, "labels")).where("predicted = 1").select(docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each near-duplicate group (three-word shingles, two bits); of repeated rows one."""
    ship_package(spark)
    rows = identified(docs, "doc_id", "text", "_group_rid")
    groups = written(simhash.near_duplicates(rows, shingle=3, distance=2, key="_group_rid"), "groups")
    kept = groups.where("doc_id = component_id").select(F.col("doc_id").alias("_group_rid"))
    n, different = groups.agg(F.count("*"), F.countDistinct("doc_id")).first()
    chosen = rows.join(kept.distinct(), "_group_rid", "left_semi")
    return (chosen if n == different else chosen.dropDuplicates(["_group_rid"])).select(docs.columns)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of repeated passages; those of which nothing is left go, those without a repeat stay as they are."""
    ship_package(spark)
    found = substrings.dedup_substrings(docs).where("n_removed = 0 OR n_removed < n_words")
    text = F.when(F.col("n_removed") == 0, F.col("text")).otherwise(F.col("kept"))
    n_chars = F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length("kept").cast("bigint"))
    return found.withColumns({"text": text, "n_chars": n_chars}).select(docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources ask, in one global shuffle."""
    ship_package(spark)
    return mixing.mix(docs).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences with the mixture of the whole."""
    ship_package(spark)
    return packing.pack(docs, packing.default_tokenizer())


STAGES = [
    ("quality classifier", keep_quality),
    ("SimHash near-dedup", one_of_each_group),
    ("substring dedup", without_repeats),
    ("mixing", mixed),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage but the last is a written table, so none is computed twice."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
