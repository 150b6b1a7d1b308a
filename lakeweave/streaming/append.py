"""Indexing rows as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lakeweave.functions.hashing import Signature, or_words, xash
from lakeweave.functions.text import clean_text
from lakeweave.operators.index import table_info
from lakeweave.plans.scratch import dropped, written


def stream_cells(stream: DataFrame, tableid: int, rowid: str, columns: list[str]) -> DataFrame:
    """Cells of a stream of rows that carry their row id; row-wise, so no state is kept."""
    values = F.array(*(F.col(c).cast("string") for c in columns))
    return (
        stream.select(F.col(rowid).cast("int").alias("rowid"), F.posexplode(values).alias("colid", "value"))
        .select(clean_text(F.col("value")).alias("token"), F.lit(tableid).alias("tableid"), "colid", "rowid", F.concat_ws("_", F.lit(tableid), "colid").alias("table_col_id"))
    )


def append_cells(
    stream: DataFrame, tableid: int, rowid: str, columns: list[str], path: str, checkpoint: str, signature: Signature | None = None, name: str | None = None
) -> StreamingQuery:
    """Append a stream's cells, row signatures, headers and table size to an index folder.

    Each batch has a folder of its own, so that a repeated batch replaces
    itself; :class:`LakeCatalog` reads them with all others, the size of the
    table being the largest of its batches'.  Orders of columns aren't
    written: they are those of whole columns.
    """
    sig = signature or xash()

    def write(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        at = f"batch={tableid}-{n}"
        cells = written(stream_cells(batch, tableid, rowid, columns), "batch")
        cells.write.mode("overwrite").parquet(f"{path}/cells/{at}")
        rows = cells.withColumn("w", sig.words("token")).groupBy("tableid", "rowid").agg(or_words(F.col("w"), sig.size).alias("key"))
        rows.write.mode("overwrite").parquet(f"{path}/rows/{at}")
        headers = spark.createDataFrame([(tableid, i, c) for i, c in enumerate(columns)], "tableid int, colid int, header string")
        headers.withColumn("header_tokenized", clean_text(F.col("header"), limit=None)).write.mode("overwrite").parquet(f"{path}/headers/batch={tableid}")
        names = spark.createDataFrame([(tableid, name or f"stream {tableid}")], "tableid int, dataset_name string")
        table_info(cells, names).write.mode("overwrite").parquet(f"{path}/tables/{at}")
        dropped(cells)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
