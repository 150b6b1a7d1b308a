"""Records that are the same but for blanks, letter case, punctuation and field order.

A record's canonical form is the sorted list of its canonical fields.  The
canonical records are range-partitioned and sorted (Spark's external sort),
and every partition is scanned for runs of equal neighbours, full keys being
compared.  A run gives one representative and its number of copies.  Record
ids are part of the sort key, so copies of one record that are a third of all
records spread over many partitions; runs at the ends of partitions are put
together afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from lakeweave.llm.suffixes import _differs
from lakeweave.plans.scratch import written

#: Stands between the fields of a canonical record; no canonical field holds it.
SEP = "\x01"


def canonical_text(text: Column) -> Column:
    """Letters and digits of all scripts without letter case; any other run is one blank, none at the ends.

    Case is removed by way of upper case, and a sharp s agrees with its capitals SS.
    """
    plain = F.lower(text).rlike(r"\A[a-z0-9]+( [a-z0-9]+)*\z")
    return F.when(plain, F.lower(text)).otherwise(
        F.trim(F.regexp_replace(F.replace(F.lower(F.upper(text)), F.lit("\xdf"), F.lit("ss")), r"[^\p{L}\p{N}]+", " "))
    )


def canonical_records(cells: DataFrame, record: Sequence[str], field: str, text: str) -> DataFrame:
    """(record columns r0.., key): one row per record that has any letters or digits.

    A cell (record, field) that occurs twice counts once; null texts and those
    without letters and digits are left out.  A cell without a record id belongs
    to no record.
    """
    rows = cells.select(
        *(F.col(c).alias(f"r{i}") for i, c in enumerate(record)), F.col(field).alias("f"), F.col(text).alias("x")
    )
    ids = [f"r{i}" for i in range(len(record))]
    whole = rows.where(" AND ".join(f"{c} IS NOT NULL" for c in [*ids, "x"]))
    once = whole.repartition(*ids).dropDuplicates([*ids, "f", "x"])
    texts = once.select(*ids, canonical_text(F.col("x")).alias("t")).where("t <> ''")
    return texts.groupBy(*ids).agg(F.array_join(F.array_sort(F.collect_list("t")), SEP).alias("key"))


def copies(records: DataFrame) -> DataFrame:
    """(r0.., n_copies) for every group of two or more records of one ``key``: the smallest record and their number."""
    ids = [c for c in records.columns if c != "key"]
    # written first: the ranges are told from a sample, for which the records would be made a second time
    rows = written(records.select("key", *ids), "records")
    array = rows.repartitionByRange("key", *ids).sortWithinPartitions("key", *ids)
    schema = StructType([StructField("key", StringType()), *(rows.schema[c] for c in ids), StructField("n", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, first = None, True  # the run not ended yet: one row (key, ids) and its length

        def out(starts: pa.RecordBatch, n: np.ndarray, keyed: bool) -> pa.RecordBatch:
            key = starts.column(0) if keyed else pa.nulls(starts.num_rows, starts.column(0).type)
            return pa.RecordBatch.from_arrays([key, *starts.columns[1:], pa.array(n, pa.int64())], names=schema.names)

        for b in batches:
            if not b.num_rows:
                continue
            if open_ is None:
                cols, before = b.columns, 0
            else:
                cols, before = [pa.concat_arrays([o, c]) for o, c in zip(open_[0].columns, b.columns, strict=True)], open_[1] - 1
            starts = np.concatenate([[0], np.flatnonzero(_differs(cols[0])) + 1])
            n = np.diff(np.concatenate([starts, [len(cols[0])]]))
            n[0] += before
            heads = pa.RecordBatch.from_arrays([c.take(pa.array(starts)) for c in cols], names=b.schema.names)
            ended = len(starts) - 1
            if ended and first:  # the run at the partition's start may have begun before it
                yield out(heads.slice(0, 1), n[:1], True)
            skip = int(bool(ended and first))
            first = first and not ended
            several = np.flatnonzero(n[skip:ended] > 1) + skip
            if len(several):
                yield out(heads.take(pa.array(several)), n[several], False)
            open_ = heads.slice(ended, 1), int(n[ended])
        if open_ is not None:
            yield out(open_[0], np.array([open_[1]]), True)

    runs = array.mapInArrow(run, schema)
    # runs inside a partition are complete and have no key here; each is a group by itself
    alone = F.when(F.col("key").isNull(), F.struct(*ids))
    return (
        runs.groupBy("key", alone.alias("alone"))
        .agg(F.min(F.struct(*ids)).alias("first"), F.sum("n").alias("n_copies"))
        .where("n_copies > 1").select(*(F.col("first")[c].alias(c) for c in ids), "n_copies")
    )
