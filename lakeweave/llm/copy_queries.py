"""Queries of problem 7: rows of the lake that recur with other formatting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeweave.llm import format_copies


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of every group of rows holding the same texts, and how many rows there are."""
    cells = spark.read.parquet(f"{sf_dir}/maco_main_tokenized.parquet")
    records = format_copies.canonical_records(cells, ["tableid", "rowid"], "colid", "tokenized")
    return format_copies.copies(records).select(F.col("r0").alias("tableid"), F.col("r1").alias("rowid"), "n_copies")


QUERIES = {"p7_found": p7_found}
ORACLES = {
    "p7_found": r"""WITH once AS (SELECT DISTINCT tableid, rowid, colid, tokenized FROM maco_main_tokenized WHERE tokenized IS NOT NULL),
        t AS (SELECT tableid, rowid, trim(regexp_replace(lower(replace(upper(tokenized), 'ß', 'SS')), '[^\p{L}\p{N}]+', ' ', 'g')) AS t FROM once),
        r AS (SELECT tableid, rowid, list(t ORDER BY t) AS k FROM t WHERE t <> '' GROUP BY ALL)
        SELECT min((tableid, rowid))[1] AS tableid, min((tableid, rowid))[2] AS rowid, count(*) AS n_copies
        FROM r GROUP BY k HAVING count(*) > 1"""
}
