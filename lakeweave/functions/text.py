"""Token cleaning, numeric tests and null-like values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The stop words, in the order in which they are removed.
STOPWORDS = (
    "a", "the", "of", "on", "in", "an", "and", "is", "at", "are", "as", "be", "but", "by", "for", "it",
    "no", "not", "or", "such", "that", "their", "there", "these", "to", "was", "with", "they", "will",
    "v", "ve", "d",
)
#: Longest token of the lake.
MAX_TOKEN = 200
#: Numeric tokens, after cleaning.
NUMERIC = r"^([0-9]+(e[0-9]+)?|nan|inf|infinity|)$"
_HAS_STOPWORD = r"(^| )(" + "|".join(STOPWORDS) + r")( |$)"


def clean_text(value: Column, null: str = "nan", limit: int | None = MAX_TOKEN) -> Column:
    """A cell's token: ASCII letters and digits in lower case, single blanks, stop words removed.

    Stop words go in list order, each first between blanks, then one at the
    start, then one at the end, so a lone stop word stays.  Nulls become
    ``null``.  Tokens without a stop word skip that part.
    """
    text = F.coalesce(value.cast("string"), F.lit(null))
    base = F.trim(F.lower(F.regexp_replace(F.regexp_replace(text, r"[^\x00-\x7F]", ""), "[^A-Za-z0-9]+", " ")))
    # a fold keeps the expression small; its steps bind their value by a one-element array
    def without(s: Column, w: Column) -> Column:
        inner = F.array(F.replace(s, F.concat(F.lit(" "), w, F.lit(" ")), F.lit(" ")))
        front = F.transform(inner, lambda r: F.when(F.startswith(r, F.concat(w, F.lit(" "))), F.substr(r, F.length(w) + 2)).otherwise(r))
        back = F.transform(front, lambda r: F.when(F.endswith(r, F.concat(F.lit(" "), w)), F.left(r, F.length(r) - F.length(w) - 1)).otherwise(r))
        return back[0]

    short = F.aggregate(F.array(*(F.lit(w) for w in STOPWORDS)), base, without)
    token = F.when(base.rlike(_HAS_STOPWORD), short).otherwise(base)
    return F.substring(token, 1, limit) if limit else token


def with_clean(df: DataFrame, column: str, out: str, null: str = "nan") -> DataFrame:
    """``df`` with the token of ``column``; each distinct value is cleaned once."""
    words = df.select(F.col(column).alias("__raw")).distinct().withColumn(out, clean_text(F.col("__raw"), null))
    return df.join(words, F.col(column).eqNullSafe(F.col("__raw")), "left").drop("__raw")


def is_numeric_token(token: Column) -> Column:
    """Whether a cleaned token counts as a number; null and empty tokens do."""
    return F.coalesce(token, F.lit("")).rlike(NUMERIC)


def numeric_value(token: Column) -> Column:
    """The number a token stands for; null for empty tokens and nan."""
    parsed = F.when(token.isin("inf", "infinity"), F.lit(float("inf"))).when(token.rlike("^[0-9]+(e[0-9]+)?$"), token.cast("double"))
    return F.when(~token.isin("", "nan"), parsed)


def categorical_value(token: Column) -> Column:
    """A token as a category; null and empty tokens are the category nan."""
    return F.coalesce(F.when(token != "", token), F.lit("nan"))


def null_like_in_lake(token: Column, exact: bool = False) -> Column:
    """The token, or null if it is empty or holds nan, unknown, null or none (``exact``: is one of them)."""
    names = ["nan", "unknown", "null", "none"]
    bad = token.isin(*names) if exact else token.rlike("|".join(names))
    return F.when((token != "") & ~bad, token)


def null_like_in_query(token: Column) -> Column:
    """The token, or null if it is empty, nan or unknown."""
    return F.when(~token.isin("", "nan", "unknown"), token)
