"""Point and set lookups in the index."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeweave.functions.text import null_like_in_lake


def posting_list(cells: DataFrame, tokens: DataFrame, column: str = "token") -> DataFrame:
    """Cells that hold one of the tokens."""
    return cells.join(tokens.select(F.col(column).alias("token")).distinct(), "token", "left_semi")


def posting_list_with_key(cells: DataFrame, rows: DataFrame, tokens: DataFrame, column: str = "token") -> DataFrame:
    """Cells that hold one of the tokens, with their rows' signatures."""
    return posting_list(cells, tokens, column).join(rows, ["tableid", "rowid"])


def packed_posting_list(cells: DataFrame, tokens: DataFrame, column: str = "token") -> DataFrame:
    """(entry): hits as text ``{tableid}_{rowid};{colid}_{token}``."""
    hits = posting_list(cells, tokens, column)
    return hits.select(F.concat(F.concat_ws("_", "tableid", "rowid"), F.lit(";"), F.concat_ws("_", "colid", "token")).alias("entry"))


def unpacked_posting_list(entries: DataFrame) -> DataFrame:
    """The inverse of :func:`packed_posting_list`."""
    row, cell = F.split("entry", ";", 2)[0], F.split("entry", ";", 2)[1]
    return entries.select(
        F.split(cell, "_", 2)[1].alias("token"), F.split(row, "_")[0].cast("int").alias("tableid"),
        F.split(cell, "_", 2)[0].cast("int").alias("colid"), F.split(row, "_")[1].cast("int").alias("rowid"),
    )


def rows_by_id(cells: DataFrame, ids: DataFrame) -> DataFrame:
    """All cells of the rows (tableid, rowid)."""
    return cells.join(ids.select("tableid", "rowid").distinct(), ["tableid", "rowid"], "left_semi")


def rows_by_key(cells: DataFrame, rows: DataFrame, keys: DataFrame) -> DataFrame:
    """All cells of the rows with one of the signatures in ``keys``."""
    return rows_by_id(cells, rows.join(keys.select("key").distinct(), "key", "left_semi"))


def tables(cells: DataFrame, rows: DataFrame, ids: Sequence[int]) -> DataFrame:
    """All cells of some tables, with signatures."""
    return cells.where(F.col("tableid").isin(*ids)).join(rows.where(F.col("tableid").isin(*ids)), ["tableid", "rowid"])


def columns(cells: DataFrame, table_col_ids: Sequence[str]) -> DataFrame:
    """The cells of some columns in (table_col_id, rowid) order."""
    return cells.where(F.col("table_col_id").isin(*table_col_ids)).orderBy("table_col_id", "rowid")


def column_arrays(cells: DataFrame, table_col_ids: Sequence[str]) -> DataFrame:
    """(table_col_id, rowids, tokens): some columns as arrays in row order."""
    packed = cells.where(F.col("table_col_id").isin(*table_col_ids)).groupBy("table_col_id").agg(F.array_sort(F.collect_list(F.struct("rowid", "token"))).alias("l"))
    return packed.select("table_col_id", F.col("l.rowid").alias("rowids"), F.col("l.token").alias("tokens"))


def joinable_columns(cells: DataFrame, tokens: DataFrame, k: int, column: str = "token", min_overlap: int = 1) -> DataFrame:
    """(table_col_id, overlap): the ``k`` columns that hold most of the distinct tokens."""
    return (
        posting_list(cells, tokens, column).groupBy("table_col_id").agg(F.count_distinct("token").alias("overlap"))
        .where(F.col("overlap") >= min_overlap).orderBy(F.desc("overlap"), "table_col_id").limit(k)
    )


def wide_table(cells: DataFrame, headers: DataFrame, tableid: int, exact: bool = False) -> DataFrame:
    """A table put together again: (rowid, one column per header), null-like values as null.

    The columns come from the headers, so no pass over the cells is needed to know them.
    """
    heads = headers.where(F.col("tableid") == tableid).orderBy("colid").select("colid", "header").collect()
    own = cells.where(F.col("tableid") == tableid).withColumn("token", null_like_in_lake(F.col("token"), exact))
    wide = own.groupBy("rowid").agg(
        *(F.max(F.when(F.col("colid") == h.colid, F.col("token"))).alias(f"__{h.colid}") for h in heads)
    )
    seen: dict[str, int] = {}
    names = []
    for h in heads:  # clashing headers get their position
        name = h.header if h.header is not None else f"column_{h.colid}"
        names.append(name if name not in seen and name != "rowid" else f"{name}_{h.colid}")
        seen[name] = 1
    return wide.select("rowid", *(F.col(f"__{h.colid}").alias(n) for h, n in zip(heads, names, strict=True)))
