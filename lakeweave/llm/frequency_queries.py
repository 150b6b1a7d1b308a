"""Queries of problem 2: how often values and header words occur, in how many tables, and which are of no use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeweave.llm import suffixes

#: Share of the tables from which a term is common.
COMMON = 0.05
#: Longest runs of header words that are counted.
HEADER_WORDS = 6


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/maco_main_tokenized.parquet").where(F.col("tokenized") != "")


def _headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = spark.read.parquet(f"{sf_dir}/maco_column_headers.parquet")
    words = F.filter(F.split("header_tokenized", " "), lambda w: w != "")
    return h.select("tableid", "colid", "header", words.alias("words")).where(F.size("words") > 0)


def _marks(counts: DataFrame, src: str, tables: int) -> DataFrame:
    marks = F.array_compact(F.array(
        F.when(F.col("n_occurrences") == 1, "rare"),
        F.when(F.col("n_records") >= COMMON * tables, "common"),
    ))
    return counts.select(F.lit(src).alias("src"), F.col("term")[0].alias("term"), F.explode(marks).alias("mark"))


def _cell_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.interval_counts(_cells(spark, sf_dir), ["tokenized"], "tableid", ["colid", "rowid"])


def _header_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of header words of every length, from one array."""
    return suffixes.ngram_counts(_headers(spark, sf_dir), "words", "tableid", ["colid", "header"], HEADER_WORDS)


def _header_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _header_counts(spark, sf_dir).where("n = 1")


def _n_tables(df: DataFrame) -> int:
    return df.select("tableid").distinct().count()


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values and header words that occur once, or in at least 5 % of the tables."""
    return _marks(_cell_counts(spark, sf_dir), "cell", _n_tables(_cells(spark, sf_dir))).unionByName(
        _marks(_header_words(spark, sf_dir), "header", _n_tables(_headers(spark, sf_dir)))
    )


def p2_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences and tables of every value and header word."""
    def of(src: str, counts: DataFrame) -> DataFrame:
        return counts.select(F.lit(src).alias("src"), F.col("term")[0].alias("term"), "n_occurrences", "n_records")

    return of("cell", _cell_counts(spark, sf_dir)).unionByName(of("header", _header_words(spark, sf_dir)))


def p2_header_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences and tables of every run of up to six header words."""
    return _header_counts(spark, sf_dir).select("n", F.array_join("term", " ").alias("term"), "n_occurrences", "n_records")


QUERIES = {"p2_found": p2_found, "p2_counts": p2_counts, "p2_header_ngrams": p2_header_ngrams}

_BASE = """WITH c AS (SELECT DISTINCT 'cell' AS src, tokenized AS term, tableid, colid, rowid, 0 AS i
        FROM maco_main_tokenized WHERE tokenized <> ''),
    h0 AS (SELECT tableid, colid, header, [x FOR x IN string_split(header_tokenized, ' ') IF x <> ''] AS w
        FROM (SELECT DISTINCT * FROM maco_column_headers)),
    h AS (SELECT 'header' AS src, unnest(w) AS term, tableid, colid, 0 AS rowid, 0 AS i FROM h0),
    f AS (SELECT src, term, count(*) AS n_occurrences, count(DISTINCT tableid) AS n_records
        FROM (FROM c UNION ALL FROM h) GROUP BY ALL)"""
ORACLES = {
    "p2_found": f"""{_BASE}, t AS (SELECT src, count(DISTINCT tableid) AS n FROM (FROM c UNION ALL FROM h) GROUP BY src)
        SELECT src, term, 'rare' AS mark FROM f WHERE n_occurrences = 1
        UNION ALL SELECT src, term, 'common' FROM f JOIN t USING (src) WHERE n_records >= {COMMON} * n""",
    "p2_counts": f"{_BASE} SELECT src, term, n_occurrences, n_records FROM f",
    "p2_header_ngrams": f"""{_BASE}, g AS (SELECT tableid, w, unnest(range(1, len(w) + 1)) AS i FROM h0),
        n AS (SELECT tableid, k AS n, array_to_string(w[i : i + k - 1], ' ') AS term
            FROM g, (SELECT unnest(range(1, {HEADER_WORDS + 1})) AS k) AS v WHERE i + k - 1 <= len(w))
        SELECT CAST(n AS INT) AS n, term, count(*) AS n_occurrences, count(DISTINCT tableid) AS n_records FROM n GROUP BY ALL""",
}
