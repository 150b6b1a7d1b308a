"""The lake's index: cells, rows with their signatures, headers, table sizes and rank orders."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeweave.functions import hashing
from lakeweave.functions.text import categorical_value, clean_text, is_numeric_token, numeric_value
from lakeweave.operators.ranges import average_ranks, running_totals


#: Rows of a column that one row of the stored order holds.
BLOCK = 100_000


@dataclass(frozen=True)
class LakeTable:
    """A table to be indexed; ``order`` is a total order of its rows, which gives the row ids."""

    tableid: int
    name: str
    df: DataFrame
    order: Sequence[str]
    null: str = "nan"
    columns: Sequence[str] = field(default=())

    def names(self) -> list[str]:
        return list(self.columns) or self.df.columns


def _sort_keys(table: LakeTable, width: int) -> list[Column]:
    """The order columns of a table as ``width`` groups of a long, a double and a string, of which one is set."""
    kinds = dict(table.df.dtypes)
    out = []
    for i in range(width):
        name = table.order[i] if i < len(table.order) else None
        c = F.col(f"`{name}`") if name is not None else F.lit(None)
        kind = kinds.get(name, "")
        whole, real = kind in ("tinyint", "smallint", "int", "bigint"), kind in ("float", "double")
        out += [
            (c if whole else F.lit(None)).cast("long").alias(f"__l{i}"), (c if real else F.lit(None)).cast("double").alias(f"__d{i}"),
            (F.lit(None) if whole or real else c).cast("string").alias(f"__s{i}"),
        ]
    return out


def wide_rows(tables: Sequence[LakeTable]) -> DataFrame:
    """(tableid, rowid, cells, null): the rows of several tables in order, cells as strings.

    Row ids are dense in each table's order; all tables are numbered in one
    job and no task holds a whole table.
    """
    width, rows = max(len(t.order) for t in tables), None
    for t in tables:
        strings = F.array(*(F.col(f"`{c}`").cast("string") for c in t.names()))
        one = t.df.select(F.lit(t.tableid).alias("tableid"), *_sort_keys(t, width), strings.alias("cells"), F.lit(t.null).alias("null"), F.lit(1).alias("one"))
        rows = one if rows is None else rows.unionByName(one)
    order = [F.col(f"__{k}{i}") for i in range(width) for k in "lds"] + [F.col("cells")]
    placed = running_totals(rows, ["tableid"], order, "one")
    return placed.select("tableid", F.col("__before").cast("int").alias("rowid"), "cells", "null")


def raw_cells(tables: Sequence[LakeTable]) -> DataFrame:
    """(tableid, colid, rowid, value, null): one row per cell."""
    return wide_rows(tables).select("tableid", "rowid", "null", F.posexplode("cells").alias("colid", "value")).select("tableid", "colid", "rowid", "value", "null")


def index_cells(tables: Sequence[LakeTable]) -> DataFrame:
    """Inverted index of several tables, one row per cell: (token, tableid, colid, rowid, table_col_id)."""
    return cells_of(raw_cells(tables))


def cells_of(raw: DataFrame) -> DataFrame:
    """Cells with their tokens, of (tableid, colid, rowid, value, null)."""
    return raw.select(
        clean_text(F.coalesce("value", "null")).alias("token"), "tableid", "colid", "rowid",
        F.concat_ws("_", "tableid", "colid").alias("table_col_id"),
    )


def index_headers(spark: SparkSession, tables: Sequence[LakeTable]) -> DataFrame:
    """(tableid, colid, header, header_tokenized)."""
    rows = [(t.tableid, i, c) for t in tables for i, c in enumerate(t.names())]
    df = spark.createDataFrame(rows, "tableid int, colid int, header string")
    return df.withColumn("header_tokenized", clean_text(F.col("header"), limit=None))


def table_info(cells: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(tableid, [dataset_name,] max_row_id, max_col_id): number of rows and last column id."""
    info = cells.groupBy("tableid").agg((F.max("rowid") + 1).alias("max_row_id"), F.max("colid").alias("max_col_id"))
    if names is None:
        return info
    return info.join(names, "tableid").select("tableid", "dataset_name", "max_row_id", "max_col_id")


def row_signatures(cells: DataFrame, signature: hashing.Signature | None = None) -> DataFrame:
    """(tableid, rowid, key): bitwise OR of the signatures of a row's cells, each distinct token hashed once."""
    sig = signature or hashing.xash()
    vocabulary = cells.select("token").distinct().withColumn("w", sig.words("token"))
    keyed = cells.select("tableid", "rowid", "token").join(vocabulary, "token")
    return keyed.groupBy("tableid", "rowid").agg(hashing.or_words(F.col("w"), sig.size).alias("key"))


def with_super_key(cells: DataFrame, rows: DataFrame, size: int = 128) -> DataFrame:
    """Cells with their row's signature as text of 0 and 1, as the index stores it."""
    return cells.join(rows, ["tableid", "rowid"]).withColumn("super_key", hashing.bit_string(F.col("key"), size)).drop("key")


def numeric_columns(cells: DataFrame) -> DataFrame:
    """(table_col_id, is_numeric): whether every token of a column is a number."""
    return cells.groupBy("table_col_id").agg(F.every(is_numeric_token(F.col("token"))).alias("is_numeric"))


def _placed(cells: DataFrame) -> DataFrame:
    """(table_col_id, rowid, token, is_numeric, rk, before): average rank of every cell in its column, and the cells of smaller rank.

    Distinct values are counted and ranked by ranges, so a column may be of any length.
    """
    typed = cells.join(numeric_columns(cells), "table_col_id").select(
        "table_col_id", "rowid", "token", "is_numeric",
        F.when(F.col("is_numeric"), numeric_value(F.col("token"))).alias("x"),
        F.when(~F.col("is_numeric"), categorical_value(F.col("token"))).alias("c"),
    )
    ranks = average_ranks(typed, ["table_col_id"], ["x", "c"]).select(
        F.col("table_col_id").alias("__t"), F.col("x").alias("__x"), F.col("c").alias("__c"), "rk", "before"
    )
    on = (F.col("table_col_id") == F.col("__t")) & F.col("x").eqNullSafe(F.col("__x")) & F.col("c").eqNullSafe(F.col("__c"))
    return typed.join(ranks, on).select("table_col_id", "rowid", "token", "is_numeric", "rk", "before")


def column_ranks(cells: DataFrame) -> DataFrame:
    """(table_col_id, rowid, token, is_numeric, rk): average rank of every cell in its column; missing numbers are last and equal."""
    return _placed(cells).drop("before")


def order_blocks(cells: DataFrame, size: int = BLOCK) -> DataFrame:
    """(table_col_id, is_numeric, block, row_list, binary_list): the rows of every column in rank order, cut into blocks of ``size`` rows.

    ``binary_list`` tells of each row by 1 or 0 whether its rank differs from
    that of the row before.  Of equal ranks the smaller row comes first.  No
    task and no row holds a whole column.
    """
    ranked = _placed(cells).withColumn("__one", F.lit(1))
    at = running_totals(ranked, ["table_col_id"], [F.col("rk"), F.col("rowid")], "__one")
    row = F.struct("__before", "rowid", F.when(F.col("__before") == F.col("before"), "1").otherwise("0").alias("new"))
    blocks = at.groupBy("table_col_id", "is_numeric", F.floor(F.col("__before") / size).cast("int").alias("block")).agg(F.array_sort(F.collect_list(row)).alias("l"))
    return blocks.select("table_col_id", "is_numeric", "block", F.col("l.rowid").alias("row_list"), F.array_join("l.new", "").alias("binary_list"))


def order_positions(blocks: DataFrame) -> DataFrame:
    """(table_col_id, is_numeric, rowid, at, run): the place of each row in its column's order, and the number of the run of equal values that it is in."""
    changes = F.length(F.translate("binary_list", "0", ""))
    earlier = Window.partitionBy("table_col_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row for a whole block
    based = blocks.withColumn("run0", F.coalesce(F.sum(changes).over(earlier), F.lit(0))).withColumn("at0", F.coalesce(F.sum(F.size("row_list")).over(earlier), F.lit(0)))
    rows = based.select("table_col_id", "is_numeric", "block", "run0", "at0", F.posexplode(F.arrays_zip("row_list", F.split("binary_list", "").alias("new"))).alias("i", "r"))
    here = Window.partitionBy("table_col_id", "block").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)  # a block has a bounded size
    return rows.select(
        "table_col_id", "is_numeric", F.col("r.row_list").alias("rowid"), (F.col("at0") + F.col("i")).alias("at"),
        (F.col("run0") + F.sum(F.col("r.new").cast("int")).over(here)).alias("run"),
    )


def category_runs(blocks: DataFrame) -> DataFrame:
    """(table_col_id, run, n, first_row): the runs of equal values of the columns that aren't numeric, in order."""
    rows = order_positions(blocks.where("NOT is_numeric"))
    return rows.groupBy("table_col_id", "run").agg(F.count(F.lit(1)).alias("n"), F.min("rowid").alias("first_row"))


def order_ranks(blocks: DataFrame) -> DataFrame:
    """(table_col_id, rowid, rk): average ranks told from the stored order of the columns."""
    rows = order_positions(blocks)
    runs = rows.groupBy("table_col_id", "run").agg((F.min("at") + (F.count(F.lit(1)) + 1) / 2).alias("rk"))
    return rows.join(runs, ["table_col_id", "run"]).select("table_col_id", "rowid", "rk")


def joined_ranks(blocks: DataFrame, pairs: DataFrame) -> DataFrame:
    """(table_col_id, input_row, e): ranks of the joined rows among each other, told from the stored order of the columns.

    ``pairs``: (tableid, ext_row, input_row).  Equal values have the average of
    their ranks; of several rows for one input row the last in order counts.
    """
    rows = order_positions(blocks).withColumn("tableid", F.split("table_col_id", "_")[0].cast("int"))
    joined = rows.join(pairs.select("tableid", F.col("ext_row").alias("rowid"), "input_row"), ["tableid", "rowid"])
    runs = joined.groupBy("table_col_id", "run").agg(F.count(F.lit(1)).alias("__w"))
    total = running_totals(runs, ["table_col_id"], [F.col("run")], "__w")
    ranks = total.select("table_col_id", "run", (F.col("__before") + (F.col("__w") + 1) / 2).alias("e"))
    return joined.join(ranks, ["table_col_id", "run"]).groupBy("table_col_id", "input_row").agg(F.max_by("e", F.struct("e", "rowid")).alias("e"))


def order_index(cells: DataFrame) -> DataFrame:
    """(table_col_id, is_numeric, min_index, order_list, binary_list): each row's successor in rank order, and whether its rank differs.

    This form has a whole column in one row by definition; :func:`order_blocks`
    tells the same of columns of any length.
    """
    at = order_positions(order_blocks(cells))
    after = at.select(F.col("table_col_id").alias("__t"), (F.col("at") - 1).alias("__at"), F.col("rowid").alias("next"), F.col("run").alias("__run"))
    linked = at.join(after, (F.col("table_col_id") == F.col("__t")) & (F.col("at") == F.col("__at")), "left").select(
        "table_col_id", "is_numeric", "rowid", "at", F.coalesce("next", F.lit(-1)).alias("next"), F.when(F.col("__run") != F.col("run"), "1").otherwise("0").alias("flag")
    )
    return linked.groupBy("table_col_id", "is_numeric").agg(
        F.min_by("rowid", "at").alias("min_index"), F.array_sort(F.collect_list(F.struct("rowid", "next", "flag"))).alias("l"),
    ).select("table_col_id", "is_numeric", "min_index", F.col("l.next").alias("order_list"), F.array_join("l.flag", "").alias("binary_list"))


def decode_order_index(index: DataFrame) -> DataFrame:
    """Order lists and flags stored as text (comma-joined, T and F) as arrays of int."""
    return index.select(
        "table_col_id", "is_numeric", "min_index",
        F.transform(F.split("order_list", ","), lambda x: x.cast("int")).alias("order_list"),
        F.transform(F.split(F.translate("binary_list", "TF", "10"), ","), lambda x: x.cast("int")).alias("binary_list"),
    )
