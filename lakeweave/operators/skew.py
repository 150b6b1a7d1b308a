"""Per-key results where a few keys hold most of the rows.

Rows are compressed to one row per (key, value) with its frequency before
anything is brought together by key alone, so the work per key depends on its
distinct values only, and what is computed from the weighted values (counts,
distinct counts, modes, percentiles) is exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeweave.operators.ranges import running_totals

#: Rows of one value are counted in blocks of this many row numbers, so that one huge (key, value) is counted by many tasks.
BLOCK = 65536


def value_frequencies(
    df: DataFrame,
    key: str,
    value: str,
    unit: Sequence[str] | None = None,
    block_on: str | None = None,
) -> DataFrame:
    """(key, value, weight): how many rows hold each pair.

    ``unit``: columns that identify a row; a row that occurs again is counted
    once.  ``block_on``: an integer column of ``unit`` by which the rows of one
    huge pair are spread over tasks.  Null keys and values are groups like any
    other; other columns of ``df`` are ignored.  An empty input has no rows.
    """
    cols = {"__k": F.col(key), "__v": F.col(value)}
    if unit is None:
        pairs = df.select(*(c.alias(n) for n, c in cols.items()))
        return (
            pairs.groupBy("__k", "__v").agg(F.count(F.lit(1)).alias("weight"))
            .select(F.col("__k").alias("key"), F.col("__v").alias("value"), "weight")
        )
    rest = [c for c in unit if c not in (key, value)]
    block = F.coalesce(F.floor(F.col(block_on) / BLOCK), F.lit(0)) if block_on else F.lit(0).cast("bigint")
    rows = df.select(
        *(c.alias(n) for n, c in cols.items()),
        block.alias("__b"),
        *(F.col(c).alias(f"__u{i}") for i, c in enumerate(rest)),
    )
    # one exchange serves both the removal of repeated rows and the count by (key, value, block)
    once = rows.repartition("__k", "__v", "__b").dropDuplicates()
    return (
        once.groupBy("__k", "__v", "__b").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("__k", "__v").agg(F.sum("n").alias("weight"))
        .select(F.col("__k").alias("key"), F.col("__v").alias("value"), "weight")
    )


def key_counts(freq: DataFrame) -> DataFrame:
    """(key, n_rows, n_values) from :func:`value_frequencies`; a null value isn't counted as a value."""
    return freq.groupBy("key").agg(
        F.sum("weight").alias("n_rows"), F.count("value").alias("n_values")
    )


def key_modes(freq: DataFrame) -> DataFrame:
    """(key, mode, mode_rows): the most frequent value of each key, ties to the smallest; null values don't count."""
    return (
        freq.where(F.col("value").isNotNull())
        .groupBy("key")
        .agg(
            F.min_by(F.struct("value", "weight"), F.struct(-F.col("weight"), F.col("value"))).alias("m")
        )
        .select("key", F.col("m.value").alias("mode"), F.col("m.weight").alias("mode_rows"))
    )


def key_percentiles(freq: DataFrame, ps: Sequence[float]) -> DataFrame:
    """(key, p, percentile): the smallest value whose cumulated weight reaches ``p`` of the key's weight.

    The values of one key may spread over any number of tasks.  Null values
    don't count.
    """
    known = freq.where(F.col("value").isNotNull())
    total = running_totals(known, ["key"], [F.col("value")], "weight")
    return (
        total.withColumn("p", F.explode(F.array(*(F.lit(float(p)) for p in ps))))
        .where(F.col("__before") + F.col("weight") >= F.col("p") * F.col("__total"))
        .groupBy("key", "p")
        .agg(F.min("value").alias("percentile"))
    )
