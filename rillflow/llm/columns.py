"""Column expressions that several operators share."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space that separates words, as a Java and RE2 pattern.
SPACE = r"[\x20\x09-\x0D]+"


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z, every other character unchanged; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def words(text: Column) -> Column:
    """The words of a text in order; none for null or white space."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def unused(name: str, *frames: DataFrame) -> str:
    """``name``, with underscores before it as long as a column of ``frames`` has it."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def id_text(name: str = "doc_id") -> Column:
    """An id as text, for tasks in pandas: there a whole number beside a null would become a float and lose digits."""
    return F.col(name).cast("string").alias(name)


def id_back(df: DataFrame, name: str = "doc_id") -> DataFrame:
    """The frame with its ids as whole numbers again."""
    return df.withColumn(name, F.col(name).cast("long"))
