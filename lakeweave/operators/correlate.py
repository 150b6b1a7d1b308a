"""Which columns of joinable tables correlate with a target, without joining every table in full."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeweave.functions.text import categorical_value, numeric_value
from lakeweave.operators.index import numeric_columns
from lakeweave.operators.lookup import joinable_columns
from lakeweave.operators.ranges import average_ranks, running_totals


def target_ranks(data: DataFrame, target: str) -> DataFrame:
    """(input_row, t): average rank of the target over the input rows; NaN counts as null."""
    x = F.col(target).cast("double")
    typed = data.select("input_row", F.when(~F.isnan(x), x).alias("x"))
    ranks = average_ranks(typed, [], ["x"]).select(F.col("x").alias("__x"), F.col("rk").alias("t"))
    return typed.join(ranks, F.col("x").eqNullSafe(F.col("__x"))).select("input_row", "t")


def column_scores(cells: DataFrame, pairs: DataFrame, targets: DataFrame) -> DataFrame:
    """(tableid, colid, table_col_id, is_numeric, corr) of every column of the joined tables.

    ``pairs``: (tableid, ext_row, input_row), a row of the lake having one input
    row at most; join columns are to be left out by the caller.  Numeric
    columns: correlation of the target's ranks with the ranks of the joined
    rows' values over all input rows; of several rows for one input row the
    last in rank order counts, input rows without one have the middle rank.
    Categorical columns: largest absolute correlation of the target's ranks
    with any one category.  Null where either side doesn't vary.
    """
    kinds = numeric_columns(cells.join(pairs.select("tableid").distinct(), "tableid", "left_semi"))
    joined = (
        cells.withColumnRenamed("rowid", "ext_row").join(pairs.select("tableid", "ext_row", "input_row"), ["tableid", "ext_row"])
        .join(kinds, "table_col_id").select("tableid", "colid", "table_col_id", "is_numeric", "ext_row", "input_row", "token")
    )
    total = targets.agg(
        F.count(F.lit(1)).alias("n"), F.sum("t").alias("st"), F.sum(F.col("t") * F.col("t")).alias("stt")
    )
    ids = ["tableid", "colid", "table_col_id", "is_numeric"]

    numbers = joined.where("is_numeric").withColumn("x", numeric_value(F.col("token")))
    ranks = average_ranks(numbers, ["table_col_id"], ["x"]).select(F.col("table_col_id").alias("__t"), F.col("x").alias("__x"), F.col("rk").alias("e"))
    ranked = numbers.join(ranks, (F.col("table_col_id") == F.col("__t")) & F.col("x").eqNullSafe(F.col("__x")))
    one = ranked.groupBy(*ids, "input_row").agg(F.max_by("e", F.struct("e", "ext_row")).alias("e"))
    sums = one.join(targets, "input_row").groupBy(*ids).agg(
        F.count(F.lit(1)).alias("m"), F.sum("e").alias("se0"), F.sum(F.col("e") * F.col("e")).alias("see0"),
        F.sum(F.col("e") * F.col("t")).alias("ste0"), F.sum("t").alias("stm"),
    )
    d = F.ceil(F.col("n") / 2)
    full = sums.join(total, F.lit(True)).select(
        *ids, "n", "st", "stt",
        (F.col("se0") + (F.col("n") - F.col("m")) * d).alias("se"),
        (F.col("see0") + (F.col("n") - F.col("m")) * d * d).alias("see"),
        (F.col("ste0") + (F.col("st") - F.col("stm")) * d).alias("ste"),
    )
    vt = F.col("n") * F.col("stt") - F.col("st") * F.col("st")
    ve = F.col("n") * F.col("see") - F.col("se") * F.col("se")
    cov = F.col("n") * F.col("ste") - F.col("st") * F.col("se")
    numeric = full.select(*ids, F.when((vt > 0) & (ve > 0), cov / (F.sqrt(vt) * F.sqrt(ve))).alias("corr"))

    cats = joined.where("NOT is_numeric").withColumn("c", categorical_value(F.col("token")))
    per = (
        cats.select(*ids, "c", "input_row").distinct().join(targets, "input_row")
        .groupBy(*ids, "c").agg(F.count(F.lit(1)).alias("q"), F.sum("t").alias("s"))
        .join(total, F.lit(True))
    )
    sigma = F.sqrt(vt) / F.col("n")
    r = F.when(
        (F.col("q") < F.col("n")) & (vt > 0),
        (F.col("n") * F.col("s") - F.col("q") * F.col("st")) / (sigma * F.col("n") * F.sqrt(F.col("q") * (F.col("n") - F.col("q")))),
    )
    categorical = per.groupBy(*ids).agg(F.max(F.abs(r)).alias("corr"))
    return numeric.unionByName(categorical)


def enrich_multicolumn(cells: DataFrame, pairs: DataFrame, targets: DataFrame, k_c: int) -> DataFrame:
    """(rank, corr, table_col_id, is_numeric): the ``k_c`` columns of largest absolute correlation.

    ``pairs`` as a join search gives them, with the join columns ``cols``, which are no features.
    """
    keys = pairs.select("tableid", F.explode("cols").alias("colid")).distinct()
    rest = cells.join(pairs.select("tableid").distinct(), "tableid", "left_semi").join(keys, ["tableid", "colid"], "left_anti")
    scores = column_scores(rest, pairs, targets)
    top = scores.where("corr IS NOT NULL").orderBy(F.abs("corr").desc(), "table_col_id").limit(k_c)
    return top.select(
        F.row_number().over(Window.orderBy(F.abs("corr").desc(), "table_col_id")).alias("rank"), "corr", "table_col_id", "is_numeric"
    )


def enrich_single(cells: DataFrame, query: DataFrame, targets: DataFrame, k_c: int, k_t: int) -> DataFrame:
    """(rank, corr, table_col_id, is_numeric, join_col): the ``k_c`` columns of largest signed correlation over the ``k_t`` best joinable columns.

    ``query``: (input_row, q0).  A token joins the last row that holds it in
    the column; of several input rows the last one counts.
    """
    joinable = joinable_columns(cells, query.select(F.col("q0").alias("token")), k_t)
    keyed = cells.join(joinable.select("table_col_id"), "table_col_id", "left_semi")
    last = keyed.groupBy("tableid", "table_col_id", "token").agg(F.max("rowid").alias("ext_row"))
    pairs = (
        last.join(query, F.col("token") == F.col("q0")).groupBy("tableid", F.col("table_col_id").alias("join_col"), "ext_row")
        .agg(F.max("input_row").alias("input_row"))
    )
    # one feature column may be reached by several join columns of its table: tell them apart by a joint id
    feats = cells.join(pairs.select("tableid", "join_col").distinct(), "tableid").where("table_col_id <> join_col")
    feats = feats.select("token", F.concat_ws("|", "join_col", "tableid").alias("tableid"), "colid", "rowid", F.concat_ws("|", "join_col", "table_col_id").alias("table_col_id"))
    joint = pairs.select(F.concat_ws("|", "join_col", "tableid").alias("tableid"), "ext_row", "input_row")
    scores = column_scores(feats, joint, targets).where("corr IS NOT NULL").select(
        "corr", F.split("table_col_id", r"\|")[1].alias("table_col_id"), "is_numeric", F.split("table_col_id", r"\|")[0].alias("join_col")
    )
    top = scores.orderBy(F.desc("corr"), "table_col_id", "join_col").limit(k_c)
    return top.select(
        F.row_number().over(Window.orderBy(F.desc("corr"), "table_col_id", "join_col")).alias("rank"),
        "corr", "table_col_id", "is_numeric", "join_col",
    )


def pearson(df: DataFrame, x: str, y: str) -> Column:
    """Aggregate: correlation of two columns over rows where both are numbers; null where one doesn't vary."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    ok = a.isNotNull() & b.isNotNull() & ~F.isnan(a) & ~F.isnan(b)
    a, b = F.when(ok, a), F.when(ok, b)
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def with_category_codes(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with text columns replaced by the position of each value among the sorted distinct ones; -1 for null."""
    for i, c in enumerate(columns):
        values = df.select(F.col(c).alias("__v")).where("__v IS NOT NULL").distinct().withColumn("__one", F.lit(1))
        codes = running_totals(values, [], [F.col("__v")], "__one").select("__v", F.col("__before").cast("int").alias(f"__code{i}"))
        df = df.join(codes, F.col(c) == F.col("__v"), "left").withColumn(c, F.coalesce(f"__code{i}", F.lit(-1))).drop("__v", f"__code{i}")
    return df


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x, y, corr) of all pairs of columns in one aggregation; text columns by their category codes."""
    kinds = dict(df.dtypes)
    coded = with_category_codes(df.select(*columns), [c for c in columns if kinds[c] == "string"])
    names = [(x, y) for i, x in enumerate(columns) for y in columns[i:]]
    row = coded.agg(*(pearson(coded, x, y).alias(f"c{i}") for i, (x, y) in enumerate(names)))
    entries = [F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"c{i}").alias("corr")) for i, (x, y) in enumerate(names) for a, b in {(x, y), (y, x)}]
    return row.select(F.explode(F.array(*entries)).alias("e")).select("e.*")
