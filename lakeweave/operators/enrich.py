"""Attaching chosen columns of the lake to a dataset, and preparing datasets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeweave.functions.text import clean_text
from lakeweave.operators.lookup import wide_table


def group_mean(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean of every numeric column per key; other columns are dropped."""
    numeric = [c for c, t in df.dtypes if c not in keys and t.split("(")[0] in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")]
    return df.groupBy(*keys).agg(*(F.avg(c).alias(c) for c in numeric))


def mean_impute(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Nulls and NaN of numeric columns replaced by the column's mean, which is computed in one aggregation."""
    def known(c: str):
        x = F.col(c).cast("double")
        return F.when(~F.isnan(x), x)

    means = df.agg(*(F.avg(known(c)).alias(f"__m_{c}") for c in columns))
    out = df.join(F.broadcast(means), F.lit(True))  # one row
    return out.withColumns({c: F.coalesce(known(c), F.col(f"__m_{c}")) for c in columns}).drop(*means.columns)


def strip_headers(df: DataFrame) -> DataFrame:
    """Column names without blanks around them."""
    return df.toDF(*(c.strip() for c in df.columns))


def add_features(
    df: DataFrame, keys: Sequence[str], cells: DataFrame, headers: DataFrame, tableid: int, cols: Sequence[int], features: Sequence[int]
) -> DataFrame:
    """``df`` left-joined with some columns of a lake table on cleaned keys.

    Of external rows with the same keys the first is used.  Features are named
    ``{tableid}_{colid}:{header}``.
    """
    heads = {r.colid: r.header for r in headers.where(F.col("tableid") == tableid).select("colid", "header").collect()}
    wanted = [*cols, *features]
    own = cells.where((F.col("tableid") == tableid) & F.col("colid").isin(*wanted))
    wide = own.groupBy("rowid").agg(*(F.max(F.when(F.col("colid") == c, F.col("token"))).alias(f"__x{i}") for i, c in enumerate(wanted)))
    key_cols = [f"__x{i}" for i in range(len(cols))]
    first = wide.groupBy(*key_cols).agg(
        F.min_by(F.struct(*(F.col(f"__x{i}") for i in range(len(cols), len(wanted)))), "rowid").alias("__f")
    )
    named = first.select(
        *key_cols, *(F.col("__f")[f"__x{len(cols) + i}"].alias(f"{tableid}_{c}:{heads.get(c)}") for i, c in enumerate(features))
    )
    keyed = df.withColumns({f"__k{i}": clean_text(F.col(f"`{k}`")) for i, k in enumerate(keys)})
    on = [F.col(f"__k{i}") == F.col(f"__x{i}") for i in range(len(keys))]
    return keyed.join(named, on, "left").drop(*(f"__k{i}" for i in range(len(keys))), *key_cols)


def drop_columns(df: DataFrame, suffix: str) -> DataFrame:
    """``df`` without the columns whose names end in ``suffix``."""
    return df.drop(*(c for c in df.columns if c.endswith(suffix)))


def keep_ranks(tables: DataFrame, k: int) -> DataFrame:
    """The first ``k`` tables of a search result."""
    return tables.where(F.col("rank") <= k)


def preview(cells: DataFrame, headers: DataFrame, tableid: int, n: int) -> DataFrame:
    """The first ``n`` rows of a lake table."""
    return wide_table(cells, headers, tableid).orderBy("rowid").limit(n)


def header_of(results: DataFrame, headers: DataFrame) -> DataFrame:
    """Search results with the headers of their columns as an array, in order."""
    at = results.select("*", F.posexplode("cols").alias("__i", "colid"))
    named = at.join(headers.select("tableid", "colid", "header"), ["tableid", "colid"], "left")
    return named.groupBy(*results.columns).agg(F.transform(F.array_sort(F.collect_list(F.struct("__i", "header"))), lambda s: s["header"]).alias("headers"))

