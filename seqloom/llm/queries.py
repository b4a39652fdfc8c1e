"""Queries of the training-data problems over the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm import leakage, mixture, neardup, quality, subset
from seqloom.session import table


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of alignment rows that are nearly the same sequence."""
    return neardup.all_pairs(neardup.near_duplicates(table(spark, sf_dir, "align_rows")))


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each alignment row with its class of equal rows and the number of other classes that it is linked to."""
    found = neardup.near_duplicates(table(spark, sf_dir, "align_rows"))
    ends = found["links"].select(F.explode(F.array("a", "b")).alias("class"))
    degree = ends.groupBy("class").agg(F.count("*").alias("n"))
    return found["members"].join(degree, "class", "left").select("seq_id", F.col("class").alias("class_id"), F.coalesce("n", F.lit(0)).alias("n_links"))


def _train(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    rows = table(spark, sf_dir, "align_rows").where("split = 'Train'")
    return subset.varied_subset(rows, table(spark, sf_dir, "families"))


def p5_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A varied subset of each family's Train rows."""
    return _train(spark, sf_dir)["selected"].select("family", "seq_id", "subfamily")


def p5_quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and quota of each subfamily."""
    combos = _train(spark, sf_dir)["combinations"]
    return combos.groupBy("family", "subfamily").agg(F.sum("count").alias("n_rows"), F.sum("quota").alias("n_selected"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold test material, with the items that leaked."""
    return leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def p6_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test items that leaked, each with the number of documents and the longest stretch."""
    found = leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    return found.groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_documents"), F.max("n_words").alias("longest_stretch"))


def p7_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each mixing plan, with how often each is used."""
    return mixture.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))["selected"]


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares that each plan's sources reach."""
    return mixture.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))["report"]


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are hardly prose, with their kind."""
    return quality.kinds(table(spark, sf_dir, "documents"), with_statistics=False).where("kind is not null")


def p8_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text statistics of each document, and its kind."""
    return quality.kinds(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (p4_found, p4_groups, p5_selected, p5_quotas, p6_found, p6_items, p7_selected, p7_report, p8_found, p8_statistics)}
SQL: dict[str, str] = {}
