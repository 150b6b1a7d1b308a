"""Queries over the given lake index (maco_* tables), whole tables.

The given relations hold what an index build must give, so signatures and
cleaned headers are checked against stored values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeweave.functions import hashing
from lakeweave.functions.text import clean_text, null_like_in_query
from lakeweave.operators import correlate, duplicates, index, joinsearch, lookup
from lakeweave.plans.lake_queries import _KIND, _SCORES
from lakeweave.plans.scratch import written

#: The table of the lake that serves as input dataset of the searches.
INPUT_TABLE = 1


_cells: dict[tuple[str, str], DataFrame] = {}


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lake's cells, each once; missing tokens are no cells.  Written once per session and folder, as an index has them."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _cells:
        m = spark.read.parquet(f"{sf_dir}/maco_main_tokenized.parquet")
        once = m.select(F.col("tokenized").alias("token"), "tableid", "colid", "rowid", "table_col_id").where("token IS NOT NULL")
        _cells[key] = written(once.dropDuplicates(["tableid", "colid", "rowid", "token", "table_col_id"]), "cells")
    return _cells[key]


def _query(c: DataFrame, cols: list[int]) -> DataFrame:
    """(input_row, q0, ..) from the input table's columns; repeated tuples keep the first row."""
    own = c.where((F.col("tableid") == INPUT_TABLE) & F.col("colid").isin(*cols))
    wide = own.groupBy("rowid").agg(*(F.max(F.when(F.col("colid") == k, null_like_in_query(F.col("token")))).alias(f"q{i}") for i, k in enumerate(cols)))
    qs = [f"q{i}" for i in range(len(cols))]
    return wide.dropna(subset=qs).groupBy(*qs).agg(F.min("rowid").alias("input_row"))


def H2_lake_super_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signatures computed anew of all rows that have a stored one."""
    stored = spark.read.parquet(f"{sf_dir}/maco_main_tokenized.parquet").where("super_key IS NOT NULL").select("tableid", "rowid").distinct()
    keys = index.row_signatures(cells(spark, sf_dir))
    return keys.join(stored, ["tableid", "rowid"]).select("tableid", "rowid", hashing.bit_string(F.col("key"), 128).alias("super_key"))


def M3_lake_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned form of every header, where it is stored too."""
    h = spark.read.parquet(f"{sf_dir}/maco_column_headers.parquet").where("header IS NOT NULL AND header_tokenized IS NOT NULL").distinct()
    return h.select("tableid", "colid", "header", clean_text(F.col("header"), limit=None).alias("header_tokenized"))


def M4_lake_table_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.table_info(cells(spark, sf_dir)).select("tableid", "max_row_id", "max_col_id")


def L7_lake_numeric_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.numeric_columns(cells(spark, sf_dir))


def W1_lake_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.column_ranks(cells(spark, sf_dir)).select("table_col_id", "rowid", "rk")


def A1_lake_joinable_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 columns that share most values with the input table's first column."""
    c = cells(spark, sf_dir)
    return lookup.joinable_columns(c, c.where(f"table_col_id = '{INPUT_TABLE}_0'"), 20)


def _search(spark: SparkSession, sf_dir: str, use_hash: bool) -> joinsearch.JoinSearch:
    c = cells(spark, sf_dir)
    return joinsearch.join_search(c, _query(c, [0, 3]), 20, 200, use_hash=use_hash)


def C1_lake_join_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables that join with the input table on two columns."""
    return _search(spark, sf_dir, True).tables.withColumn("cols", F.array_join(F.col("cols").cast("array<string>"), "_"))


def C3_lake_join_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, False).tables.withColumn("cols", F.array_join(F.col("cols").cast("array<string>"), "_"))


def C9_lake_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of which one holds every row of the other."""
    return duplicates.contained_tables(cells(spark, sf_dir))


def C6_lake_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of the joined tables that correlate with the input table's row order."""
    s = _search(spark, sf_dir, True)
    c = cells(spark, sf_dir)
    rows = c.where(F.col("tableid") == INPUT_TABLE).select(F.col("rowid").alias("input_row")).distinct()
    targets = correlate.target_ranks(rows.withColumn("x", F.col("input_row")), "x")
    return correlate.enrich_multicolumn(c, written(s.pairs, "pairs"), targets, 10).withColumn("corr", F.round("corr", 6))


QUERIES = {f.__name__: f for f in (
    H2_lake_super_keys, M3_lake_headers, M4_lake_table_info, L7_lake_numeric_columns, W1_lake_ranks, A1_lake_joinable_columns,
    C1_lake_join_search, C3_lake_join_search, C6_lake_features, C9_lake_relations,
)}

_CELLS = "WITH cells AS MATERIALIZED (SELECT DISTINCT tokenized AS token, tableid, colid, rowid, table_col_id FROM maco_main_tokenized WHERE tokenized IS NOT NULL)"
_NUM = "regexp_matches(token, '^([0-9]+(e[0-9]+)?|nan|inf|infinity|)$')"
_SEARCH = f"""{_CELLS}, w AS (SELECT rowid, max(CASE WHEN colid = 0 AND token NOT IN ('', 'nan', 'unknown') THEN token END) AS q0,
        max(CASE WHEN colid = 3 AND token NOT IN ('', 'nan', 'unknown') THEN token END) AS q1 FROM cells WHERE tableid = {INPUT_TABLE} AND colid IN (0, 3) GROUP BY rowid),
    q AS (SELECT q0, q1, min(rowid) AS input_row FROM w WHERE q0 IS NOT NULL AND q1 IS NOT NULL GROUP BY ALL),
    hits AS (SELECT tableid, count(*) AS n FROM cells WHERE token IN (SELECT q0 FROM q) GROUP BY 1 ORDER BY n DESC, tableid LIMIT 200),
    placed AS (SELECT h.tableid, h.rowid, h.colid, q.input_row, list(c.colid ORDER BY c.colid) FILTER (c.token = q.q1) AS at1
        FROM cells h SEMI JOIN hits USING (tableid) JOIN q ON h.token = q.q0 JOIN cells c ON c.tableid = h.tableid AND c.rowid = h.rowid GROUP BY ALL),
    mt AS MATERIALIZED (SELECT tableid, rowid, input_row, [colid] || at1 AS cols FROM placed WHERE at1 IS NOT NULL),
    ct AS (SELECT tableid, cols, count(*) AS score FROM mt GROUP BY ALL),
    best AS (SELECT * FROM ct QUALIFY row_number() OVER (PARTITION BY tableid ORDER BY score DESC, cols) = 1),
    top AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY score DESC, tableid) AS INT) AS rank, * FROM best ORDER BY score DESC, tableid LIMIT 20)"""
_TABLES = f"{_SEARCH} SELECT rank, score, score - 1 AS score_ref, tableid, array_to_string(cols, '_') AS cols FROM top"

ORACLES = {
    "H2_lake_super_keys": "SELECT DISTINCT tableid, rowid, super_key FROM maco_main_tokenized WHERE super_key IS NOT NULL AND (tableid, rowid) IN (SELECT (tableid, rowid) FROM maco_main_tokenized WHERE tokenized IS NOT NULL)",
    "M3_lake_headers": "SELECT DISTINCT tableid, colid, header, header_tokenized FROM maco_column_headers WHERE header IS NOT NULL AND header_tokenized IS NOT NULL",
    "M4_lake_table_info": f"{_CELLS} SELECT tableid, CAST(max(rowid) + 1 AS INT) AS max_row_id, max(colid) AS max_col_id FROM cells GROUP BY 1",
    "L7_lake_numeric_columns": f"{_CELLS} SELECT table_col_id, bool_and({_NUM}) AS is_numeric FROM cells GROUP BY 1",
    "W1_lake_ranks": f"""{_CELLS}, k AS (SELECT table_col_id, bool_and({_NUM}) AS num FROM cells GROUP BY 1),
        v AS (SELECT table_col_id, rowid, CASE WHEN num AND token NOT IN ('', 'nan') THEN TRY_CAST(token AS DOUBLE) END AS x, CASE WHEN NOT num THEN CASE WHEN token = '' THEN 'nan' ELSE token END END AS c FROM cells JOIN k USING (table_col_id))
        SELECT table_col_id, rowid, CAST(rank() OVER (PARTITION BY table_col_id ORDER BY x NULLS LAST, c NULLS LAST) + (count(*) OVER (PARTITION BY table_col_id, x, c) - 1) / 2 AS DOUBLE) AS rk FROM v""",
    "A1_lake_joinable_columns": f"""{_CELLS} SELECT table_col_id, count(DISTINCT token) AS overlap FROM cells WHERE token IN (SELECT token FROM cells WHERE table_col_id = '{INPUT_TABLE}_0')
        GROUP BY 1 ORDER BY overlap DESC, table_col_id LIMIT 20""",
    "C1_lake_join_search": _TABLES,
    "C3_lake_join_search": _TABLES,
    "C6_lake_features": f"""{_SEARCH}, {_KIND}, prs AS MATERIALIZED (SELECT tableid, cols, rowid AS ext_row, max(input_row) AS input_row FROM mt SEMI JOIN top USING (tableid, cols) GROUP BY ALL),
        r AS (SELECT DISTINCT rowid FROM cells WHERE tableid = {INPUT_TABLE}), tg AS MATERIALIZED (SELECT rowid AS input_row, CAST(row_number() OVER (ORDER BY rowid) AS DOUBLE) AS t FROM r),
        pairs AS (SELECT CAST(tableid AS VARCHAR) AS grp, ext_row, input_row FROM prs), kc AS (SELECT DISTINCT tableid, unnest(cols) AS colid FROM prs),
        feat AS (SELECT CAST(tableid AS VARCHAR) AS grp, table_col_id AS fid, is_numeric, token, rowid FROM cells JOIN kind USING (table_col_id)
            WHERE tableid IN (SELECT tableid FROM prs) AND (tableid, colid) NOT IN (SELECT tableid, colid FROM kc)), {_SCORES}
        SELECT CAST(row_number() OVER (ORDER BY abs(corr) DESC, fid) AS INT) AS rank, round(corr, 6) AS corr, fid AS table_col_id, is_numeric FROM sc WHERE corr IS NOT NULL ORDER BY rank LIMIT 10""",
    "C9_lake_relations": f"""{_CELLS}, v AS (SELECT DISTINCT tableid, vals FROM (SELECT tableid, rowid, list(token ORDER BY token) AS vals FROM cells GROUP BY ALL)),
        n AS (SELECT tableid, count(*) AS n FROM v GROUP BY 1),
        m AS (SELECT a.tableid AS a, b.tableid AS b, count(*) AS k FROM v a JOIN v b ON a.vals = b.vals AND a.tableid < b.tableid GROUP BY ALL)
        SELECT a AS tableid_1, b AS tableid_2 FROM m JOIN n x ON x.tableid = a JOIN n y ON y.tableid = b WHERE k = least(x.n, y.n)""",
}
