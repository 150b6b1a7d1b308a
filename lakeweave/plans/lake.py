"""The lake that the queries search: tables derived from the driver's, with fixed ids and row orders.

One definition serves the Spark side and, as common table expressions, the SQL side.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeweave.functions.text import STOPWORDS, clean_text
from lakeweave.operators import index
from lakeweave.operators.index import LakeTable
from lakeweave.plans.scratch import written

_GEO = "SELECT n_name, r_name, n_nationkey FROM {nation} JOIN {region} ON n_regionkey = r_regionkey"
_STATS = """SELECT n_name, CAST(coalesce(c.n, 0) AS INT) AS n_customers, CAST(coalesce(s.n, 0) AS INT) AS n_suppliers, g.seg AS top_segment
    FROM {nation}
    LEFT JOIN (SELECT c_nationkey, count(*) AS n FROM {customer} GROUP BY c_nationkey) c ON c_nationkey = n_nationkey
    LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM {supplier} GROUP BY s_nationkey) s ON s_nationkey = n_nationkey
    LEFT JOIN (SELECT k, seg FROM (SELECT c_nationkey AS k, c_mktsegment AS seg,
            row_number() OVER (PARTITION BY c_nationkey ORDER BY count(*) DESC, c_mktsegment) AS i
            FROM {customer} GROUP BY c_nationkey, c_mktsegment) x WHERE i = 1) g ON g.k = n_nationkey"""
_DIM = "SELECT p_brand, p_type, CAST(count(*) AS INT) AS n_parts, max(p_size) AS max_size FROM {part} GROUP BY p_brand, p_type"

#: id, name, columns, rows, order
TABLES = [
    (1, "region", ["r_regionkey", "r_name"], "SELECT * FROM {region}", ["r_regionkey"]),
    (2, "nation", ["n_nationkey", "n_name", "n_regionkey"], "SELECT * FROM {nation}", ["n_nationkey"]),
    (3, "supplier", ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"], "SELECT * FROM {supplier}", ["s_suppkey"]),
    (4, "customer", ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"], "SELECT * FROM {customer}", ["c_custkey"]),
    (5, "part", ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"], "SELECT * FROM {part}", ["p_partkey"]),
    (6, "nation_shuffled", ["n_regionkey", "n_name", "n_nationkey"], "SELECT *, -n_nationkey AS down FROM {nation}", ["down"]),
    (7, "nation_head", ["n_nationkey", "n_name", "n_regionkey"], "SELECT * FROM {nation} WHERE n_nationkey < 12", ["n_nationkey"]),
    (8, "nation_geo", ["n_name", "r_name", "n_nationkey"], _GEO, ["n_nationkey"]),
    (9, "nation_stats", ["n_name", "n_customers", "n_suppliers", "top_segment"], _STATS, ["n_name"]),
    (10, "part_dim", ["p_brand", "p_type", "n_parts", "max_size"], _DIM, ["p_brand", "p_type"]),
]
_SOURCES = ["region", "nation", "supplier", "customer", "part"]

#: Input datasets: rows and order.
Q1 = (
    """SELECT n_name, r_name, floor(b * 100 + 0.5) / 100 AS avg_bal FROM (
        SELECT n_name, r_name, CAST(sum(CAST(c_acctbal AS DECIMAL(18, 2))) AS DOUBLE) / count(*) AS b
        FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey GROUP BY n_name, r_name) x""",
    ["n_name"],
)
Q2 = ("SELECT r_name, r_regionkey FROM {region}", ["r_regionkey"])
Q3 = (
    """SELECT p_brand, p_type, floor(b * 100 + 0.5) / 100 AS price FROM (
        SELECT p_brand, p_type, CAST(sum(CAST(p_retailprice AS DECIMAL(18, 2))) AS DOUBLE) / count(*) AS b FROM {part} GROUP BY p_brand, p_type) x""",
    ["p_brand", "p_type"],
)


def _run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    used = {s: spark.read.parquet(f"{sf_dir}/{s}.parquet") for s in _SOURCES if "{" + s + "}" in sql}
    return spark.sql(sql, **used)


def tables(spark: SparkSession, sf_dir: str) -> list[LakeTable]:
    return [LakeTable(i, name, _run(spark, sf_dir, sql), order, columns=cols) for i, name, cols, sql, order in TABLES]


def dataset(spark: SparkSession, sf_dir: str, q: tuple[str, list[str]]) -> tuple[DataFrame, list[str]]:
    """(rows, order) of an input dataset."""
    return _run(spark, sf_dir, q[0]), q[1]


@dataclass
class Lake:
    cells: DataFrame
    headers: DataFrame
    info: DataFrame

    @cached_property
    def rows(self) -> DataFrame:
        """Row signatures, made when a query first asks for them."""
        return written(index.row_signatures(self.cells), "rows")


_lakes: dict[tuple[str, str], Lake] = {}


def lake(spark: SparkSession, sf_dir: str) -> Lake:
    """The index of the lake, built once per session and folder and written to the shared folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _lakes:
        ts = tables(spark, sf_dir)
        cells = written(index.index_cells(ts), "cells")
        names = spark.createDataFrame([(t.tableid, t.name) for t in ts], "tableid int, dataset_name string")
        _lakes[key] = Lake(cells, index.index_headers(spark, ts), index.table_info(cells, names))
    return _lakes[key]


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` dealt out to all cores by ``columns``: for work that costs much more than its bytes tell."""
    spark = df.sparkSession
    return df.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *columns)


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(token): the distinct tokens of all cells; each distinct value is cleaned once, and no row is numbered for it."""
    values = None
    for t in tables(spark, sf_dir):
        one = t.df.select(F.explode(F.array(*(F.coalesce(F.col(c).cast("string"), F.lit(t.null)) for c in t.names()))).alias("value"))
        values = one if values is None else values.unionByName(one)
    return spread(values.distinct(), "value").select(clean_text(F.col("value")).alias("token")).distinct()


# -- the same for SQL ----------------------------------------------------


def _plain(sql: str) -> str:
    return sql.format(**{s: s for s in _SOURCES})


def sql_clean(value: str, null: str = "nan") -> str:
    """A cell's token, uncut: stop words one after the other by a fold over their list."""
    base = f"trim(regexp_replace(regexp_replace(lower(regexp_replace(coalesce(CAST({value} AS VARCHAR), '{null}'), '[^\\x00-\\x7F]', '', 'g')), '[^a-z0-9]+', ' ', 'g'), ' +', ' ', 'g'))"
    words = ", ".join(f"'{w}'" for w in STOPWORDS)
    middle = "replace(s, ' ' || w || ' ', ' ')"
    front = f"CASE WHEN starts_with({middle}, w || ' ') THEN substr({middle}, length(w) + 2) ELSE {middle} END"
    back = f"CASE WHEN ends_with({front}, ' ' || w) THEN left({front}, length({front}) - length(w) - 1) ELSE {front} END"
    return f"list_reduce([{base}, {words}], lambda s, w: {back})"


def sql_dataset(q: tuple[str, list[str]]) -> str:
    return f"SELECT *, CAST(row_number() OVER (ORDER BY {', '.join(q[1])}) - 1 AS INT) AS input_row FROM ({_plain(q[0])}) ds"


def sql_raw(ids: list[int] | None = None) -> str:
    parts = []
    for i, _, cols, sql, order in TABLES:
        if ids is None or i in ids:
            vals = ", ".join(f"CAST({c} AS VARCHAR)" for c in cols)
            parts.append(
                f"SELECT {i} AS tableid, CAST(unnest(range({len(cols)})) AS INT) AS colid, CAST(rid AS INT) AS rowid, unnest([{vals}]) AS value "
                f"FROM (SELECT *, row_number() OVER (ORDER BY {', '.join(order)}) - 1 AS rid FROM ({_plain(sql)}) t{i})"
            )
    return " UNION ALL ".join(parts)


def sql_cells(ids: list[int] | None = None) -> str:
    """WITH clause that defines raw(tableid, colid, rowid, value) and cells(token, tableid, colid, rowid, table_col_id)."""
    return f"""WITH RECURSIVE raw AS MATERIALIZED ({sql_raw(ids)}),
        vocab AS MATERIALIZED (SELECT value, left({sql_clean('value')}, 200) AS token FROM (SELECT DISTINCT value FROM raw)),
        cells AS MATERIALIZED (SELECT token, tableid, colid, rowid, tableid || '_' || colid AS table_col_id
            FROM raw JOIN vocab ON raw.value IS NOT DISTINCT FROM vocab.value)"""


def sql_xash(tokens: str, size: int = 128, rotation: bool = True, ones: int = 5, name: str = "xash") -> str:
    """CTEs that give {name}(token, ps), ps being the sorted bit positions, from a query of distinct tokens."""
    m = {64: 1, 128: 3, 256: 6, 512: 13}[size]
    body = 37 * m
    tail = size - body
    d = f"CAST(floor({body} * (len % {tail}) / {tail}) AS INT)" if rotation else "0"
    return f"""{name}_t AS (SELECT token, length(token) AS len FROM ({tokens}) WHERE token NOT IN ('', 'None', ' ', '''''')),
        {name}_c AS (SELECT token, len, substr(token, CAST(i AS INT) + 1, 1) AS c, i FROM (SELECT token, len, unnest(range(len)) AS i FROM {name}_t)),
        {name}_n AS (SELECT token, len, c, count(*) AS n, sum(i) AS s, row_number() OVER (PARTITION BY token ORDER BY count(*), c) AS k FROM {name}_c GROUP BY token, len, c),
        {name}_p AS (SELECT token, CAST(((strpos(' 0123456789abcdefghijklmnopqrstuvwxyz', c) - 1) * {m}
                + greatest(0, (s * {m} + len * n - 1) // (len * n) - 1) + {d}) % {body} AS INT) AS p
            FROM {name}_n WHERE k <= {ones} AND strpos(' 0123456789abcdefghijklmnopqrstuvwxyz', c) > 0
            UNION SELECT token, CAST({body} + len % {tail} AS INT) FROM {name}_t),
        {name} AS MATERIALIZED (SELECT v.token, coalesce(list_sort(list(DISTINCT p) FILTER (p IS NOT NULL)), []) AS ps
            FROM ({tokens}) v LEFT JOIN {name}_p q ON v.token = q.token GROUP BY v.token)"""


def sql_bits(ps: str, size: int = 128) -> str:
    return f"array_to_string(list_transform(range({size - 1}, -1, -1), lambda b: CASE WHEN list_contains({ps}, b) THEN '1' ELSE '0' END), '')"
