"""Queries of problems 8 and 9: encoding and packing of documents.text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeweave.llm import bpe, packing


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document by byte_bpe_50k, without special tokens; null and empty texts have none."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return bpe.encode_texts(docs, "doc_id", "text", bpe.SharedEncoder(spark)).withColumnRenamed("id", "doc_id")


#: Confidence from which a scanned line is fit to be learned from.
READABLE = 0.93
LIMITS = packing.Limits(tokens=2048, segments=16, loss=1536)


def p9_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every page: 2,048 tokens, 16 pages and 1,536 loss-bearing tokens, which are those of the lines that the scanner read well."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "doc_id", "text", F.transform("boxes", lambda b: F.coalesce(b["conf"] >= READABLE, F.lit(False))).alias("bears")
    )
    return packing.pack_texts(docs, "doc_id", "text", bpe.SharedEncoder(spark), LIMITS, "bears").withColumnRenamed("id", "doc_id")


def p9_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full every container is in each dimension."""
    return p9_packed(spark, sf_dir).groupBy("container_id").agg(
        F.sum("n_tokens").alias("n_tokens"), F.count(F.lit(1)).alias("n_pages"), F.sum("n_loss").alias("n_loss")
    )


def p9_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of the containers: rows placed, and how many places break a rule."""
    packed = p9_packed(spark, sf_dir)
    pages = packed.groupBy("doc_id").agg(
        F.count_if(F.col("piece") == 0).alias("rows"), F.max("piece").alias("last"), F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("places")
    )
    held = packed.groupBy("container_id").agg(
        F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("segments"), F.sum("n_loss").alias("loss"), F.count_if(F.col("n_loss") > 0).alias("bearing")
    )
    by_page = pages.agg(
        F.count(F.lit(1)).alias("pages"), F.sum("rows").alias("placed"),
        F.count_if((F.col("places") > F.col("rows")) & (F.col("tokens") <= LIMITS.tokens * F.col("rows"))).alias("split_needlessly"),
        F.count_if((F.col("places") == F.col("rows")) & (F.col("tokens") > LIMITS.tokens * F.col("rows"))).alias("not_split"),
    )
    by_container = held.agg(
        F.count_if(F.col("tokens") > LIMITS.tokens).alias("too_many_tokens"), F.count_if(F.col("segments") > LIMITS.segments).alias("too_many_pages"),
        F.count_if((F.col("loss") > LIMITS.loss) & (F.col("bearing") > 1)).alias("too_much_loss"),
    )
    return by_page.join(by_container, F.lit(True))  # one row each


QUERIES = {"p8_ids": p8_ids, "p9_packed": p9_packed, "p9_fill": p9_fill, "p9_checks": p9_checks}
_NONE = ", ".join(f"CAST(0 AS BIGINT) AS {c}" for c in ("split_needlessly", "not_split", "too_many_tokens", "too_many_pages", "too_much_loss"))
ORACLES = {"p9_checks": f"SELECT count(DISTINCT doc_id) AS pages, CAST(count(*) AS BIGINT) AS placed, {_NONE} FROM documents"}
