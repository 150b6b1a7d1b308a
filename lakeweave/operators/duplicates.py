"""Tables of the lake that hold the same rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeweave.plans.scratch import written


def row_values(cells: DataFrame) -> DataFrame:
    """(tableid, rowid, n_cols, vals): the sorted tokens of every row."""
    return cells.groupBy("tableid", "rowid").agg(F.array_sort(F.collect_list("token")).alias("vals")).withColumn("n_cols", F.size("vals"))


def duplicate_tables(cells: DataFrame, rows: DataFrame, tableid: int, full: bool = False) -> DataFrame:
    """(tableid): tables with a row that has the same signature and values as row 0 of a table, itself included.

    ``full``: tables that hold all rows of the table.
    """
    values = row_values(cells).join(rows, ["tableid", "rowid"])
    probe = values.where(F.col("tableid") == tableid)
    if not full:
        probe = probe.where("rowid = 0")
    found = values.join(probe.select(F.col("rowid").alias("probe"), "key", "vals"), ["key", "vals"])
    hit = found.groupBy("tableid").agg(F.count_distinct("probe").alias("n"))
    total = probe.agg(F.count(F.lit(1)).alias("all_rows"))
    return hit.join(total, F.col("n") >= F.col("all_rows")).select("tableid")


def duplicate_relations(cells: DataFrame, rows: DataFrame, distinct: bool = False) -> DataFrame:
    """(tableid_1, tableid_2, n_pairs), tableid_1 < tableid_2: tables of as many columns whose equal row pairs are at least the smaller one's rows.

    Rows are equal if signatures and sorted values are.  ``distinct``: every
    row of the smaller table must have a partner, instead of counting pairs
    (repeated rows can then not stand in for missing ones).  Equal rows are
    counted per table first, and only tables that can reach the count meet.
    """
    values = row_values(cells).join(rows, ["tableid", "rowid"]).select("tableid", "rowid", "n_cols", "key", "vals")
    kinds = values.groupBy("tableid", "n_cols", "key", "vals").agg(F.count(F.lit(1)).alias("n"))
    sizes = values.groupBy("tableid").agg(F.count(F.lit(1)).alias("rows"), F.min_by("n_cols", "rowid").alias("cols"))
    kinds = written(kinds, "kinds")
    # if the smaller table lacks a partner for some row, another row must be repeated in the larger one:
    # so a pair shares the smaller one's rarest row, or a row that one of them repeats
    spread = kinds.groupBy("n_cols", "key", "vals").agg(F.count(F.lit(1)).alias("tables"))
    rarest = (
        kinds.join(spread, ["n_cols", "key", "vals"]).groupBy("tableid")
        .agg(F.min_by(F.struct("n_cols", "key", "vals"), F.struct("tables", "key", "vals")).alias("r")).select("tableid", "r.*")
    )
    start = rarest.unionByName(kinds.where("n > 1").select("tableid", "n_cols", "key", "vals")).distinct()
    near = start.withColumnRenamed("tableid", "x").join(kinds.withColumnRenamed("tableid", "y"), ["n_cols", "key", "vals"]).where("x <> y")
    pairs = near.select(F.least("x", "y").alias("tableid_1"), F.greatest("x", "y").alias("tableid_2")).distinct()
    a = kinds.select(F.col("tableid").alias("tableid_1"), "n_cols", "key", "vals", F.col("n").alias("n1"))
    b = kinds.select(F.col("tableid").alias("tableid_2"), "n_cols", "key", "vals", F.col("n").alias("n2"))
    met = pairs.join(a, "tableid_1").join(b, ["tableid_2", "n_cols", "key", "vals"])
    counts = met.groupBy("tableid_1", "tableid_2").agg(
        F.sum(F.col("n1") * F.col("n2")).alias("n_pairs"), F.sum("n1").alias("m1"), F.sum("n2").alias("m2")
    )
    s1 = sizes.select(F.col("tableid").alias("tableid_1"), F.col("rows").alias("r1"), F.col("cols").alias("c1"))
    s2 = sizes.select(F.col("tableid").alias("tableid_2"), F.col("rows").alias("r2"), F.col("cols").alias("c2"))
    sized = counts.join(s1, "tableid_1").join(s2, "tableid_2").where("c1 = c2")
    if distinct:
        sized = sized.where(F.when(F.col("r1") <= F.col("r2"), F.col("m1") == F.col("r1")).otherwise(F.col("m2") == F.col("r2")))
    else:
        sized = sized.where(F.col("n_pairs") >= F.least("r1", "r2"))
    return sized.select("tableid_1", "tableid_2", "n_pairs")


def duplicates_of_all(cells: DataFrame, rows: DataFrame, tableids: Sequence[int]) -> DataFrame:
    """(tableid): the duplicates of several tables one after the other, repeats kept."""
    out = None
    for t in tableids:
        one = duplicate_tables(cells, rows, t)
        out = one if out is None else out.unionByName(one)
    return out


@dataclass
class Contained:
    """``members``: (tableid, rep), every table with the smallest table of the same rows; ``pairs``: (small, big) of such
    representatives, the first one's rows all being in the second."""

    members: DataFrame
    pairs: DataFrame


def contained_classes(cells: DataFrame) -> Contained:
    """Tables that hold the same rows, and which of these hold all rows of others.

    Rows are equal if their sorted values are; repeated rows of a table don't
    count.  Tables of the same rows are one class, told by the number of
    their different rows and two sums over the rows' hashes, so no row of any
    result holds a whole table, and a row that is in very many copies of one
    table meets once.  A class can only be held by classes that hold its rarest
    row, so only those are compared; rows common to many classes make no
    candidates unless a class has nothing rarer.
    """
    values = cells.groupBy("tableid", "rowid").agg(F.array_sort(F.collect_list("token")).alias("vals"))
    kinds = written(values.select("tableid", F.md5(F.concat_ws("\x01", "vals")).alias("kind"), F.size("vals").alias("n")).distinct(), "kinds")
    told = kinds.groupBy("tableid").agg(
        F.count(F.lit(1)).alias("kinds"), F.sum(F.xxhash64("kind", "n").cast("decimal(38,0)")).alias("s"), F.bit_xor(F.xxhash64(F.lit(7), "n", "kind")).alias("x")
    )
    reps = told.groupBy("kinds", "s", "x").agg(F.min("tableid").alias("rep"))
    members = written(told.join(reps, ["kinds", "s", "x"]).select("tableid", "rep", "kinds"), "classes")
    own = kinds.join(members.where("tableid = rep").select("tableid", "kinds"), "tableid")
    spread = own.groupBy("kind", "n").agg(F.count(F.lit(1)).alias("classes"))
    rarest = own.join(spread, ["kind", "n"]).groupBy(F.col("tableid").alias("small"), "kinds").agg(
        F.min_by(F.struct("kind", "n"), F.struct("classes", "kind", "n")).alias("r")
    ).select("small", "kinds", "r.kind", "r.n")
    # only a class with more rows can hold another one
    near = rarest.join(own.select(F.col("tableid").alias("big"), F.col("kinds").alias("more"), "kind", "n"), ["kind", "n"]).where("more > kinds").select("small", "big", "kinds")
    pairs = (
        near.join(own.select(F.col("tableid").alias("small"), "kind", "n"), "small").join(own.select(F.col("tableid").alias("big"), "kind", "n"), ["big", "kind", "n"])
        .groupBy("small", "big", "kinds").agg(F.count(F.lit(1)).alias("held")).where("held = kinds").select("small", "big")
    )
    return Contained(members.select("tableid", "rep"), pairs)


def contained_tables(cells: DataFrame) -> DataFrame:
    """(tableid_1, tableid_2), tableid_1 < tableid_2: all pairs of tables of which one holds every row of the other; as :func:`contained_classes` otherwise."""
    found = contained_classes(cells)
    of = found.members
    a, b = of.select(F.col("tableid").alias("x"), F.col("rep").alias("small")), of.select(F.col("tableid").alias("y"), F.col("rep").alias("big"))
    across = found.pairs.join(a, "small").join(b, "big").select("x", "y")
    within = a.join(b.withColumnRenamed("big", "small"), "small").where("x < y").select("x", "y")
    return across.unionByName(within).select(F.least("x", "y").alias("tableid_1"), F.greatest("x", "y").alias("tableid_2"))


def remove_duplicates(tables: DataFrame, relations: DataFrame) -> DataFrame:
    """Tables without those that are the larger id of a relation."""
    gone = relations.select(F.col("tableid_2").alias("tableid")).distinct()
    return tables.join(gone, "tableid", "left_anti")
