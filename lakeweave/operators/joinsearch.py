"""Which tables of the lake join with a dataset on several columns at once."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeweave.functions.hashing import Signature, contained, row_key, xash
from lakeweave.functions.text import clean_text, null_like_in_query
from lakeweave.operators.index import row_signatures
from lakeweave.operators.ranges import running_totals
from lakeweave.plans.scratch import written


@dataclass
class JoinSearch:
    """``tables``: (rank, score, score_ref, tableid, cols); ``pairs``: (tableid, cols, ext_row, input_row), one
    row per joined row of the winning columns; ``stats``: counters of the signature filter, computed when asked for."""

    tables: DataFrame
    pairs: DataFrame
    stats: DataFrame


def numbered(data: DataFrame, order: Sequence[str]) -> DataFrame:
    """An input dataset with ``input_row``, its row numbers from 0 in a total order."""
    rows = data.withColumn("__one", F.lit(1))
    placed = running_totals(rows, [], [F.col(f"`{c}`") for c in order], "__one")
    return placed.withColumn("input_row", F.col("__before").cast("int")).select(*(F.col(f"`{c}`") for c in data.columns), "input_row")


def prepare(data: DataFrame, query_columns: Sequence[str], order: Sequence[str]) -> DataFrame:
    """(input_row, q0, q1, ..): distinct query tuples with their first row number, cleaned, without null-like values.

    The dataset is numbered in the given order.
    """
    first = numbered(data, order).groupBy(*(F.col(f"`{c}`").alias(f"raw{i}") for i, c in enumerate(query_columns))).agg(F.min("input_row").alias("input_row"))
    cleaned = first.select(
        "input_row", *(null_like_in_query(clean_text(F.col(f"raw{i}"))).alias(f"q{i}") for i in range(len(query_columns)))
    )
    return cleaned.dropna(subset=[f"q{i}" for i in range(len(query_columns))])


def join_search(
    cells: DataFrame,
    query: DataFrame,
    k: int,
    k_c: int = 500,
    min_join_ratio: int = 0,
    rows: DataFrame | None = None,
    signature: Signature | None = None,
    use_hash: bool = True,
    early: bool = False,
) -> JoinSearch:
    """Top-``k`` tables by number of row pairs that agree in all query columns.

    ``query`` comes from :func:`prepare`.  Only the ``k_c`` tables with most
    hits of the first query column (and more than ``min_join_ratio``) are
    looked at.  A hit whose row signature (``rows``, computed from the cells of
    the hit rows if not given) lacks bits of the query row's is dropped before
    its row is fetched; ``use_hash=False`` skips that and gives the same tables.
    Columns that match are named by the hit's column and all columns of the row
    that hold each further value; a single query column is checked once more as
    its own further value.  Ties: smaller table id, then smaller columns.

    ``early``: the ``k`` tables with most pairs left are looked at first, and
    then only those whose pairs, which their score can't exceed, are as many
    as the k-th best score found so far.  The tables are the same; the counters
    are those of the tables that were looked at.
    """
    n = len([c for c in query.columns if c.startswith("q")])
    sig = signature or xash()
    tokens = query.select(F.col("q0").alias("token")).distinct()
    hits = cells.join(tokens, "token", "left_semi")
    chosen = (
        hits.groupBy("tableid").agg(F.count(F.lit(1)).alias("hits")).where(F.col("hits") > min_join_ratio)
        .orderBy(F.desc("hits"), "tableid").limit(k_c)
    )
    # at most k_c rows, which prune both the hits and the rows that are fetched
    chosen = F.broadcast(written(chosen.select("tableid"), "chosen"))
    cand = hits.join(chosen, "tableid", "left_semi").select("tableid", "rowid", "colid", "token")
    own = cells.join(chosen, "tableid", "left_semi")
    if use_hash:
        if rows is None:
            rows = row_signatures(own.join(cand.select("tableid", "rowid").distinct(), ["tableid", "rowid"], "left_semi"), sig)
        keyed_query = query.withColumn("qkey", row_key([f"q{i}" for i in range(n)], sig))
        pairs = cand.join(rows, ["tableid", "rowid"]).join(keyed_query, F.col("token") == F.col("q0"))
        pairs = pairs.withColumn("kept", contained(F.col("qkey"), F.col("key"), sig.size)).drop("key", "qkey")
    else:
        pairs = cand.join(query, F.col("token") == F.col("q0")).withColumn("kept", F.lit(True))
    approved = pairs.where("kept").drop("kept", "token")
    # further columns: where each value stands in the row
    further = list(range(1, n)) if n > 1 else [0]

    def verified(some: DataFrame) -> DataFrame:
        fetched = some.join(own.select("tableid", "rowid", F.col("colid").alias("c"), "token"), ["tableid", "rowid"])
        at = [F.array_sort(F.collect_list(F.when(F.col("token") == F.col(f"q{j}"), F.col("c")))).alias(f"at{j}") for j in further]
        placed = fetched.groupBy("tableid", "rowid", "colid", "input_row").agg(*at)
        for j in further:
            placed = placed.where(F.size(f"at{j}") > 0)
        return placed.select("tableid", "rowid", "input_row", F.concat(F.array("colid"), *(F.col(f"at{j}") for j in further)).alias("cols"))

    if early:
        bounds = written(approved.groupBy("tableid").agg(F.count(F.lit(1)).alias("bound")), "bounds")  # at most k_c rows
        first = bounds.orderBy(F.desc("bound"), "tableid").limit(k)
        matched = written(verified(approved.join(F.broadcast(first.select("tableid")), "tableid", "left_semi")), "matched")
        scores = matched.groupBy("tableid", "cols").agg(F.count(F.lit(1)).alias("score")).groupBy("tableid").agg(F.max("score").alias("score"))
        found = scores.agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).first()
        rest = bounds.join(first.select("tableid"), "tableid", "left_anti").where(F.col("bound") >= (found.least if found.n == k else 1))
        matched = matched.unionByName(verified(approved.join(F.broadcast(rest.select("tableid")), "tableid", "left_semi")))
    else:
        matched = verified(approved)
    counts = matched.groupBy("tableid", "cols").agg(F.count(F.lit(1)).alias("score"))
    best = counts.groupBy("tableid").agg(F.min_by(F.struct("score", "cols"), F.struct(-F.col("score"), F.col("cols"))).alias("b"))
    top = best.select("tableid", "b.score", "b.cols").orderBy(F.desc("score"), "tableid").limit(k)
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "tableid")))
    tables = ranked.select("rank", "score", (F.col("score") - 1).alias("score_ref"), "tableid", "cols")
    joined = (
        matched.join(top.select("tableid", "cols"), ["tableid", "cols"])
        .groupBy("tableid", "cols", F.col("rowid").alias("ext_row")).agg(F.max("input_row").alias("input_row"))
    )
    stats = pairs.agg(F.count_if(~F.col("kept")).alias("total_filtered"), F.count_if("kept").alias("total_approved")).join(
        matched.agg(F.count(F.lit(1)).alias("matching_rows")), F.lit(True)
    )
    stats = stats.select(
        "total_filtered", "total_approved", "matching_rows", (F.col("total_approved") - F.col("matching_rows")).alias("total_fp"),
        (F.col("matching_rows") / F.greatest(F.col("total_approved"), F.lit(1))).alias("precision"),
    )
    return JoinSearch(tables, joined, stats)


def join_map(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """(tableid, cols, join_map): for every row of a joined table its input row, or -1.

    A map has its whole table in one row by definition; ``pairs`` tells the same row by row.
    """
    joined = pairs.select("tableid", "cols").distinct().join(sizes.select("tableid", "max_row_id"), "tableid")
    rows = joined.select("tableid", "cols", F.explode(F.sequence(F.lit(0), F.col("max_row_id") - 1)).alias("ext_row"))
    told = rows.join(pairs, ["tableid", "cols", "ext_row"], "left").select("tableid", "cols", F.struct("ext_row", F.coalesce("input_row", F.lit(-1)).alias("r")).alias("s"))
    return told.groupBy("tableid", "cols").agg(F.array_sort(F.collect_list("s")).alias("l")).select("tableid", "cols", F.col("l.r").alias("join_map"))


def highlighted(cells: DataFrame, pairs: DataFrame, tableid: int) -> DataFrame:
    """Cells of one table with ``is_matched``: whether the row is joined."""
    rows = pairs.where(F.col("tableid") == tableid).select(F.col("ext_row").alias("rowid"), F.lit(True).alias("m")).distinct()
    return cells.where(F.col("tableid") == tableid).join(rows, "rowid", "left").withColumn("is_matched", F.coalesce("m", F.lit(False))).drop("m")
