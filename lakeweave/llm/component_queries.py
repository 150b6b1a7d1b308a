"""Queries of problem 4: one identifier for all tables linked by duplicate_relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeweave.llm.components import connected_components


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every linked table with the smallest table id of its group."""
    pairs = spark.read.parquet(f"{sf_dir}/duplicate_relations.parquet")
    return connected_components(pairs, "tableid_1", "tableid_2").select(
        F.col("node").alias("tableid"), F.col("component").alias("group_id")
    )


QUERIES = {"p4_found": p4_found}
ORACLES = {
    "p4_found": """WITH RECURSIVE e AS (
            SELECT tableid_1 AS a, tableid_2 AS b FROM duplicate_relations WHERE tableid_1 IS NOT NULL AND tableid_2 IS NOT NULL
            UNION SELECT tableid_2, tableid_1 FROM duplicate_relations WHERE tableid_1 IS NOT NULL AND tableid_2 IS NOT NULL),
        r AS (SELECT a, a AS b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
        SELECT a AS tableid, min(b) AS group_id FROM r GROUP BY a"""
}
