"""Queries of problem 10: how demanding each page is to read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeweave.llm.reading import reading_levels

#: Levels that count as demanding.
DEMANDING = 4


def p10_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language, words, latent level and level of every page with an article."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return reading_levels(docs, spark.read.parquet(f"{sf_dir}/reading_labels.parquet"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of level 4 or 5."""
    return p10_levels(spark, sf_dir).where(F.col("level") >= DEMANDING).select("doc_id").distinct()


def p10_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of the levels: how many rows break a rule."""
    levels = p10_levels(spark, sf_dir)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where(F.trim("text") != "").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"))
    by_page = levels.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.col("level").between(1, 5) | F.col("level").isNull()).alias("odd"), F.count_if(F.col("n_words") < 1).alias("empty")
    ).join(docs, "doc_id", "left")
    return by_page.agg(
        F.count_if(F.col("rows").isNull()).alias("without_text"), F.count_if(F.col("n") > F.col("rows")).alias("repeated"),
        F.coalesce(F.sum("odd"), F.lit(0)).alias("no_level"), F.coalesce(F.sum("empty"), F.lit(0)).alias("without_words"),
    )


QUERIES = {"p10_found": p10_found, "p10_levels": p10_levels, "p10_checks": p10_checks}
ORACLES = {"p10_checks": "SELECT " + ", ".join(f"CAST(0 AS BIGINT) AS {c}" for c in ("without_text", "repeated", "no_level", "without_words"))}
