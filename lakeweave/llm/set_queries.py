"""Queries of problem 5: columns of the lake whose value sets overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeweave.llm.set_join import similar_pairs

#: Jaccard similarity from which columns are a pair, and the distinct values that a column must have.
THRESHOLD, LEAST_VALUES = 0.7, 10


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of columns that share at least 0.7 of their distinct values."""
    cells = spark.read.parquet(f"{sf_dir}/maco_main_tokenized.parquet")
    return similar_pairs(cells, "table_col_id", "tokenized", THRESHOLD, LEAST_VALUES).select(
        F.col("id_1").alias("table_col_id_1"), F.col("id_2").alias("table_col_id_2")
    )


QUERIES = {"p5_found": p5_found}
ORACLES = {
    "p5_found": f"""WITH s AS (SELECT DISTINCT table_col_id AS c, tokenized AS t FROM maco_main_tokenized WHERE tokenized <> ''),
        n AS (SELECT c, count(*) AS n FROM s GROUP BY c HAVING count(*) >= {LEAST_VALUES}), v AS (SELECT c, t, n FROM s JOIN n USING (c)),
        p AS (SELECT a.c AS x, b.c AS y, any_value(a.n) AS nx, any_value(b.n) AS ny, count(*) AS k FROM v a JOIN v b ON a.t = b.t AND a.c < b.c GROUP BY ALL)
        SELECT x AS table_col_id_1, y AS table_col_id_2 FROM p WHERE k / (nx + ny - k) >= {THRESHOLD}"""
}
