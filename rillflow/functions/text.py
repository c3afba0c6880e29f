"""Text functions: ids, keys, paths and number formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def quoted(name: str) -> Column:
    """A column whose name may hold dots."""
    return F.col(f"`{name}`")


def columns_of(df: DataFrame) -> list[Column]:
    """All columns of a frame, safe for names with dots."""
    return [quoted(c) for c in df.columns]


def id_text(number: Column) -> Column:
    """A floating-point id as integer text; null stays null."""
    return number.cast("bigint").cast("string")


def safe_name(text: Column) -> Column:
    """Every character outside A-Z, a-z, 0-9 and underscore becomes an underscore."""
    return F.regexp_replace(text, "[^A-Za-z0-9_]", "_")


def river_reach_key(river: Column, reach: Column, xs_id: Column) -> Column:
    """The text key that links a cross-section to its reach."""
    return F.concat_ws(" ", river, reach, xs_id)


def path_part(path: Column, position: int | Column) -> Column:
    """A part of a slash-separated path; negative positions count from the end."""
    return F.element_at(F.split(path, "/"), position)


def without_suffix(name: Column, suffix: str) -> Column:
    """Strip a literal suffix."""
    return F.when(name.endswith(suffix), F.substring(name, F.lit(1), F.length(name) - len(suffix))).otherwise(name)


def or_none(value: Column) -> Column:
    """Missing text becomes the word ``None``."""
    return F.coalesce(value.cast("string"), F.lit("None"))


def python_float(value: Column) -> Column:
    """Double as the shortest decimal text in the style of model configuration files.

    Plain digits from 1e-4 up to 1e16, otherwise an exponent of at least two digits; a missing value is ``nan``.
    Most numbers already have that form in the JVM's own text; only the others take the long way.
    """
    value = value.cast("double")
    jvm = value.cast("string")
    short = ~jvm.contains("E") & (F.length(jvm) <= 17)
    return (
        F.when(value.isNull() | F.isnan(value), F.lit("nan"))
        .when(short, jvm)
        .otherwise(F.get(F.transform(F.array(_fewest_digits(value, jvm)), _plain_or_scientific), F.lit(0)))
    )


def _fewest_digits(value: Column, jvm: Column) -> Column:
    """The JVM's text may carry a 17th digit; 16 digits are used where they give the same number."""
    rounded = F.format_string("%.15E", value)
    return F.when(rounded.try_cast("double") == value, rounded).otherwise(jvm)


def _plain_or_scientific(text: Column) -> Column:
    mantissa = F.regexp_replace(F.split_part(text, F.lit("E"), F.lit(1)), r"\.?0+$", "")
    exponent = F.split_part(text, F.lit("E"), F.lit(2)).try_cast("int")
    digits = F.regexp_replace(text.try_cast(T.DecimalType(38, 20)).cast("string"), r"0+$", "")
    plain = F.regexp_replace(digits, r"\.$", ".0")
    sign = F.when(exponent < 0, F.lit("-")).otherwise(F.lit("+"))
    zero = F.when(F.abs(exponent) < 10, F.lit("0")).otherwise(F.lit(""))
    scientific = F.concat(mantissa, F.lit("e"), sign, zero, F.abs(exponent).cast("string"))
    return F.when(exponent.isNull(), text).when(exponent.between(-4, 15), plain).otherwise(scientific)


def number_list(text: Column) -> Column:
    """``"['a', 'b']"`` or ``"[(x, y), ...]"`` as a flat array of doubles."""
    bare = F.regexp_replace(text, r"[\[\]()'\s]", "")
    return F.transform(F.filter(F.split(bare, ","), lambda t: t != ""), lambda t: t.cast("double"))


def point_list(text: Column) -> Column:
    """``"[(x, y), ...]"`` as an array of structs ``(x, Y)``."""

    def pairs(flat: Column) -> Column:
        firsts = F.when(F.size(flat) > 1, F.sequence(F.lit(0), F.size(flat) - 2, F.lit(2)))
        return F.transform(firsts, lambda i: F.struct(F.get(flat, i).alias("x"), F.get(flat, i + 1).alias("Y")))

    return F.get(F.transform(F.array(number_list(text)), pairs), F.lit(0))
