"""What several operators share: input tables, words, and text as SQL expressions.

Null rule of the whole subpackage: a null text holds no words, no lines and no
bytes. Input columns keep their names and order; working columns start with
``_llm_`` so that extra columns of a caller do not clash with them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are separated by ASCII white space, as the contracts of the operators say.
SPACES = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def words_of(text: Column) -> Column:
    """The words of a non-null text; splitting a trimmed text is cheaper than extracting matches."""
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def count_of(characters: str, text: Column) -> Column:
    """How many of a few ASCII characters a text holds: one plain byte search for each of them."""
    rest = text
    for c in characters:
        rest = F.replace(rest, F.lit(c), F.lit(""))
    return (F.length(text) - F.length(rest)).cast("long")


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def fill(df: DataFrame, like: DataFrame) -> DataFrame:
    """``df`` with the columns of ``like``, in their order."""
    return df.select(*[F.col(f"`{c}`") for c in like.columns])
