"""The index as a set of Parquet tables in a folder, appended to file by file."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeweave.functions.hashing import Signature, xash
from lakeweave.functions.text import clean_text
from lakeweave.operators import index
from lakeweave.plans.scratch import dropped, written
from lakeweave.sources.bulk import read_files
from lakeweave.sources.readers import IndexReport, listed, read_any

#: The relations and their schemas.
SCHEMAS = {
    "cells": "token string, tableid int, colid int, rowid int, table_col_id string",
    "rows": "tableid int, rowid int, key array<bigint>",
    "headers": "tableid int, colid int, header string, header_tokenized string",
    "tables": "tableid int, dataset_name string, max_row_id int, max_col_id int",
    "order_index": "table_col_id string, is_numeric boolean, block int, row_list array<int>, binary_list string",
    "cells_by_row": "token string, tableid int, colid int, rowid int, table_col_id string",
}
#: Files up to so many bytes are read whole, all in one job; larger ones one by one, each by all executors.
WHOLE_FILE = 64 << 20


class LakeCatalog:
    """Builds, appends to and reads the index of a lake."""

    def __init__(self, spark: SparkSession, path: str, signature: Signature | None = None, rank_orders: bool = True, row_keys: bool = True, row_layout: bool = False):
        if not (rank_orders or row_keys):
            raise ValueError("an index needs row keys, rank orders or both")
        self.spark, self.path, self.signature = spark, path.rstrip("/"), signature or xash()
        self.rank_orders, self.row_keys = rank_orders, row_keys
        self.row_layout = row_layout
        self.pending: dict[str, int] = {}

    def __str__(self) -> str:
        return f"LakeCatalog({self.path}, {len(self.pending)} files to index, row keys {self.row_keys}, rank orders {self.rank_orders})"

    def table(self, name: str) -> DataFrame:
        """One of the relations; empty if nothing has been indexed."""
        try:
            # batches of a stream have folders of their own
            found = self.spark.read.schema(SCHEMAS[name]).option("recursiveFileLookup", "true").parquet(f"{self.path}/{name}")
            return found if name != "tables" else found.groupBy("tableid", "dataset_name").agg(*(F.max(c).alias(c) for c in ("max_row_id", "max_col_id")))
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], SCHEMAS[name])

    def by_row(self) -> DataFrame:
        """The cells in the layout in which lookups of rows, columns and tables skip row groups; the other one if there is no such copy."""
        return self.table("cells_by_row" if self.row_layout else "cells")

    def drop(self) -> None:
        """Remove all relations."""
        jvm = self.spark.sparkContext._jvm
        for name in SCHEMAS:
            p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def next_id(self) -> int:
        """The id of the next table."""
        return self.table("tables").agg(F.coalesce(F.max("tableid"), F.lit(0))).first()[0] + 1

    def add_folder(self, path: str, recursive: bool = False) -> None:
        """Note the files of a folder for indexing, those indexed already left out."""
        known = {r.dataset_name for r in self.table("tables").select("dataset_name").collect()}
        self.pending |= {p: n for p, n in sorted(listed(self.spark, path, recursive).items()) if p not in known}

    def update(self) -> IndexReport:
        """Index the noted files: all files that fit in one task are read in one job, and all are appended in one job per relation.

        A file that can't be read is counted in the report and doesn't touch the others.
        """
        report = IndexReport()
        small = [p for p, n in self.pending.items() if n <= WHOLE_FILE]
        parsed = written(read_files(self.spark, small), "parsed")
        # one row for every file
        status = {r.path: r.status for r in parsed.where("status IS NOT NULL").select("path", "status").collect()}
        large: dict[str, DataFrame] = {}
        for path in self.pending:
            if path in status:
                found = {"read": report.inserted, "data error": report.data_errors}.get(status[path], report.file_errors)
                found.append(path)
            elif path in small:
                report.file_errors.append(path)  # gone since it was noted
            else:
                df = read_any(self.spark, path, report)
                if df is not None:
                    large[path] = df
                    report.inserted.append(path)
        first = self.next_id()
        ids = {path: first + i for i, path in enumerate(report.inserted)}
        self.pending = {}
        if ids:
            self._append_files(parsed, ids, large)
        dropped(parsed)
        return report

    def _append_files(self, parsed: DataFrame, ids: dict[str, int], large: dict[str, DataFrame]) -> None:
        names = self.spark.createDataFrame(pd.DataFrame({"tableid": list(ids.values()), "dataset_name": list(ids)}), "tableid int, dataset_name string")
        own = parsed.join(names, F.col("path") == F.col("dataset_name"))  # as many rows as files: left to Spark's size check
        rows = own.where("rowid IS NOT NULL").select("tableid", F.col("rowid").cast("int").alias("rowid"), F.posexplode("cells").alias("colid", "value"))
        cells = index.cells_of(rows.withColumn("null", F.lit("nan")))
        headers = own.where("status IS NOT NULL").select("tableid", F.posexplode("cells").alias("colid", "header")).withColumn("header_tokenized", clean_text(F.col("header"), limit=None))
        if large:
            # tables have no key: their rows are ordered by all columns
            tables = [index.LakeTable(ids[path], path, df, df.columns) for path, df in large.items()]
            cells = cells.unionByName(index.index_cells(tables))
            headers = headers.unionByName(index.index_headers(self.spark, tables))
        self._write(cells, headers, names)

    def append(self, tables: Sequence[index.LakeTable]) -> None:
        """Append tables to all relations."""
        names = self.spark.createDataFrame([(t.tableid, t.name) for t in tables], "tableid int, dataset_name string")
        self._write(index.index_cells(tables), index.index_headers(self.spark, tables), names)

    def _write(self, cells: DataFrame, headers: DataFrame, names: DataFrame) -> None:
        """Cells are laid out by token, so that posting lists skip row groups; with ``row_layout`` a copy is laid out by table and row."""
        new = written(cells, "new-cells")
        new.repartitionByRange("token").sortWithinPartitions("token").write.mode("append").parquet(f"{self.path}/cells")
        if self.row_layout:
            new.repartitionByRange("tableid", "rowid").sortWithinPartitions("tableid", "rowid").write.mode("append").parquet(f"{self.path}/cells_by_row")
        if self.row_keys:
            index.row_signatures(new, self.signature).write.mode("append").parquet(f"{self.path}/rows")
        headers.write.mode("append").parquet(f"{self.path}/headers")
        if self.rank_orders:
            index.order_blocks(new).write.mode("append").parquet(f"{self.path}/order_index")
        # the table list is written last: what it names is complete
        index.table_info(new, names).write.mode("append").parquet(f"{self.path}/tables")
        dropped(new)
