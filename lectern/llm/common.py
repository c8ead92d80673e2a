"""Small column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\f\r"
ROW = "__row"


def bound(value: Column, use):
    """`use(x)` with `value` worked out once per row, also where `use` has lambdas that refer to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words(text: Column) -> Column:
    """The words of a text, split at ASCII white space; none of a null or blank text."""
    trimmed = F.trim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE + "+"))


def packed(df: DataFrame, *columns: Column) -> DataFrame:
    """The whole row as one column beside work columns, so that names of the input never clash with them."""
    return df.select(F.struct(*[df[f"`{c}`"] for c in df.columns]).alias(ROW), *columns)


def unpacked(df: DataFrame, columns: list[str], *more: Column) -> DataFrame:
    return df.select(*[F.col(ROW)[c].alias(c) for c in columns], *more)


def uniform_52(*parts: Column) -> Column:
    """52 hash bits as a long, the same for the same parts in any engine that has MD5."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")
