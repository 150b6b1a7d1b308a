"""Queries of problem 6: results per value where a handful of values hold most cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeweave.operators import skew

#: Cells that a value must have to be reported.
LEAST_CELLS = 20


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = spark.read.parquet(f"{sf_dir}/maco_main_tokenized.parquet")
    return cells.where(F.col("tokenized") != "")


def _table_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skew.value_frequencies(
        _cells(spark, sf_dir), "tokenized", "tableid",
        unit=["tokenized", "tableid", "colid", "rowid"], block_on="rowid",
    )


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that at least 20 cells hold, with their cells and tables."""
    counts = skew.key_counts(_table_frequencies(spark, sf_dir))
    return counts.where(F.col("n_rows") >= LEAST_CELLS).select(
        F.col("key").alias("tokenized"),
        F.col("n_rows").alias("n_cells"),
        F.col("n_values").alias("n_tables"),
    )


def p6_mode_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table that holds each value most often."""
    modes = skew.key_modes(_table_frequencies(spark, sf_dir))
    return modes.select(
        F.col("key").alias("tokenized"), F.col("mode").alias("tableid"), F.col("mode_rows").alias("n_cells")
    )


def p6_colid_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median and 90th percentile of the column position at which each value stands."""
    freq = skew.value_frequencies(
        _cells(spark, sf_dir), "tokenized", "colid",
        unit=["tokenized", "tableid", "colid", "rowid"], block_on="rowid",
    )
    return skew.key_percentiles(freq, [0.5, 0.9]).select(
        F.col("key").alias("tokenized"), "p", F.col("percentile").alias("colid")
    )


QUERIES = {
    "p6_found": p6_found,
    "p6_mode_table": p6_mode_table,
    "p6_colid_percentiles": p6_colid_percentiles,
}

_ONCE = """WITH once AS (SELECT DISTINCT tokenized, tableid, colid, rowid
    FROM maco_main_tokenized WHERE tokenized <> '')"""

ORACLES = {
    "p6_found": f"""{_ONCE}
        SELECT tokenized, count(*) AS n_cells, count(DISTINCT tableid) AS n_tables
        FROM once GROUP BY tokenized HAVING count(*) >= {LEAST_CELLS}""",
    "p6_mode_table": f"""{_ONCE}, f AS (
        SELECT tokenized, tableid, count(*) AS n_cells FROM once GROUP BY ALL)
        SELECT tokenized, tableid, n_cells FROM f
        QUALIFY row_number() OVER (PARTITION BY tokenized ORDER BY n_cells DESC, tableid) = 1""",
    "p6_colid_percentiles": f"""{_ONCE}, r AS (
        SELECT tokenized, colid, row_number() OVER (PARTITION BY tokenized ORDER BY colid) AS i,
               count(*) OVER (PARTITION BY tokenized) AS n FROM once)
        SELECT tokenized, p, min(colid) AS colid
        FROM r, (VALUES (0.5::DOUBLE), (0.9::DOUBLE)) AS v(p) WHERE i >= p * n GROUP BY ALL""",
}
