"""Queries of problem 1: cells and headers stored with other characters than those of their common form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeweave.llm import lookalikes


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = spark.read.parquet(f"{sf_dir}/maco_main_tokenized.parquet")
    headers = spark.read.parquet(f"{sf_dir}/maco_column_headers.parquet")
    return cells.select(F.lit("cell").alias("src"), "tableid", "colid", "rowid", F.col("tokenized").alias("text")).unionByName(
        headers.select(F.lit("header").alias("src"), "tableid", "colid", F.lit(-1).alias("rowid"), F.col("header").alias("text"))
    )


def _out_of_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _texts(spark, sf_dir)
    return lookalikes.out_of_form(texts, "text", lookalikes.fit(texts, "text"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells and headers that aren't stored in their common form."""
    return _out_of_form(spark, sf_dir).select("src", "tableid", "colid", "rowid").distinct()


def p1_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stored text that isn't in its common form, with that form and how often it is stored."""
    return _out_of_form(spark, sf_dir).groupBy("src", "text", "common").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {"p1_found": p1_found, "p1_forms": p1_forms}
ORACLES: dict[str, str] = {}
