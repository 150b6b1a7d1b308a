"""Queries of problem 3: directors and films that are spelled in many ways."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeweave.llm.names import Linked, link_names


def _linked(spark: SparkSession, sf_dir: str) -> tuple[Linked, Linked]:
    """(directors, films)."""
    movies = spark.read.parquet(f"{sf_dir}/movie.parquet").select(
        "director_name", "movie_title", F.concat(F.col("duration").cast("string"), F.lit(" "), F.col("imdb_score").cast("string")).alias("like")
    )
    short: dict[str, list[str]] = {}
    for r in spark.read.parquet(f"{sf_dir}/nicknames.parquet").where("short_form IS NOT NULL AND full_form IS NOT NULL").collect():  # a lexicon; it doesn't grow
        short.setdefault(r.short_form, []).append(r.full_form)
    films = link_names(movies, "movie_title", person=False, evidence="like")
    film_of = films.names.join(films.groups, "key").select(F.col("raw").alias("movie_title"), F.col("entity").alias("film"))
    directors = link_names(
        movies.join(film_of, "movie_title", "left"), "director_name", person=True, short_forms=short, evidence="film"
    )
    return directors, films


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of spellings of one director or film."""
    directors, films = _linked(spark, sf_dir)
    return directors.pairs().select(F.lit("director_name").alias("field"), "name_1", "name_2").unionByName(
        films.pairs().select(F.lit("movie_title").alias("field"), "name_1", "name_2")
    )


QUERIES = {"p3_found": p3_found}
ORACLES: dict[str, str] = {}
