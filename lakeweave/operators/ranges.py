"""Running totals in sorted order, without a task that holds a whole group."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from lakeweave.plans.scratch import written


def _differs(column: pa.Array) -> np.ndarray:
    """Whether each entry but the first differs from the one before; nulls equal nulls, and NaN equals NaN."""
    codes = column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    return codes[1:] != codes[:-1]


def _cumulated(group: int, weight: int):
    """Adds to sorted rows the weight of those before in the partition and group, and the partition's number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, total = TaskContext.get().partitionId(), None, 0
        for b in batches:
            if not b.num_rows:
                continue
            begins = np.zeros(b.num_rows, bool)
            keys = [b.column(i) for i in range(group)]
            for i, c in enumerate(keys):
                begins[1:] |= _differs(c)
                if last is not None:
                    begins[0] |= bool(_differs(pa.concat_arrays([last[i], c.slice(0, 1)]))[0])
            begins[0] |= last is None
            w = b.column(weight).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            before = np.cumsum(w) - w
            starts = np.flatnonzero(begins)
            # what came before the group's first row doesn't count; the first group may go on from the last batch
            base = np.concatenate([[0 if begins[0] else -total], before[starts[1:] if begins[0] else starts]])
            own = before - base[np.cumsum(begins) - int(begins[0])]
            total = int(own[-1] + w[-1])
            last = [c.slice(b.num_rows - 1, 1) for c in keys]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own), pa.array(np.full(b.num_rows, part, np.int32))], names=[*b.schema.names, "__run", "__part"])

    return run


def running_totals(df: DataFrame, group: Sequence[str], order: Sequence[Column], weight: str) -> DataFrame:
    """``df`` with ``__before``, the weight of the rows that come before in the group, and ``__total``, the group's weight.

    Rows are range-partitioned by group and order, so a group may spread over
    any number of ranges; each range is cumulated as it is sorted, and the
    totals of the group's ranges before it are added.  The ranges are written
    to the shared folder, so that both see the same ones, and nothing is
    shuffled a second time.  Rows that are equal in order follow each other in
    any order.  Weights are whole numbers; null counts as 0.
    """
    keys = [F.col(g) for g in group]
    given = {g: f"__k{i}" for i, g in enumerate(group)}
    names = [f"__c{i}" for i in range(len(df.columns))]
    ranged = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order) if keys or order else df
    flat = ranged.select(*(c.alias(given[g]) for g, c in zip(group, keys, strict=True)), F.col(f"`{weight}`").cast("long").alias("__w"), *(F.col(f"`{c}`").alias(n) for c, n in zip(df.columns, names, strict=True)))
    schema = StructType([*flat.schema.fields, StructField("__run", LongType()), StructField("__part", IntegerType())])
    done = written(flat.mapInArrow(_cumulated(len(group), len(group)), schema), "ranges")
    own = list(given.values())
    by_group = Window.partitionBy(*own)  # one row per range of a group
    earlier = by_group.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = (
        done.groupBy(*own, "__part").agg(F.max(F.col("__run") + F.coalesce("__w", F.lit(0))).alias("__n"))
        .withColumn("__base", F.coalesce(F.sum("__n").over(earlier), F.lit(0))).withColumn("__total", F.sum("__n").over(by_group))
        .select(*(F.col(k).alias(f"__g{i}") for i, k in enumerate(own)), F.col("__part").alias("__q"), "__base", "__total")
    )
    on = F.col("__part") == F.col("__q")
    for i, k in enumerate(own):
        on = on & F.col(k).eqNullSafe(F.col(f"__g{i}"))
    joined = done.join(ranges, on)
    kept = [F.col(n).alias(c) for c, n in zip(df.columns, names, strict=True)]
    return joined.select(*kept, (F.col("__base") + F.col("__run")).alias("__before"), "__total")


def average_ranks(df: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """(group.., order.., rk, before) of the distinct values of each group: average rank, nulls last and equal, and the rows before.

    Equal values are counted before anything is sorted.
    """
    counted = df.groupBy(*group, *order).agg(F.count(F.lit(1)).alias("__w"))
    total = running_totals(counted, group, [F.col(c).asc_nulls_last() for c in order], "__w")
    return total.select(*group, *order, (F.col("__before") + (F.col("__w") + 1) / 2).alias("rk"), F.col("__before").alias("before"))
