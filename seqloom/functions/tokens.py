"""Scalar and array functions on token sequences."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def full_flatten(c: Column | str) -> Column:
    """Two levels of nesting to one array."""
    return F.flatten(F.col(c) if isinstance(c, str) else c)


def cast_tokens(c: Column | str, nested: bool = False) -> Column:
    """Tokens as strings, at one or two levels."""
    c = F.col(c) if isinstance(c, str) else c
    if nested:
        return F.transform(c, lambda s: F.transform(s, lambda t: t.cast("string")))
    return F.transform(c, lambda t: t.cast("string"))


def check_token_type(df: DataFrame, column: str = "tokens") -> None:
    """A column type makes tokens alike; types that do not sort and compare are refused. Tokens that are
    variants are counted by their types, and more than one is an error that names them."""
    kind, rows = df.schema[column].dataType, df.select(F.col(column).alias("t"))
    while isinstance(kind, T.ArrayType):
        kind, rows = kind.elementType, rows.select(F.explode("t").alias("t"))
    if isinstance(kind, T.VariantType):
        # a decimal's precision and scale are its digits', not a type of its own
        named = F.regexp_replace(F.schema_of_variant("t"), r"\(.*\)", "")
        found = {r["kind"]: r["n"] for r in rows.where(F.col("t").isNotNull()).groupBy(named.alias("kind")).agg(F.count("*").alias("n")).limit(100).collect()}
        found.pop("VOID", None)  # nulls
        if len(found) > 1 or any("<" in k for k in found):
            raise ValueError(f"tokens must be of one simple type, found {found}; cast them to strings")
        return
    if not isinstance(kind, (T.StringType, T.NumericType, T.BooleanType, T.DateType, T.TimestampType)):
        raise ValueError(f"tokens must be of one simple type, not {kind.simpleString()}")


def row_tokens(columns: list[str], df: DataFrame | None = None) -> Column:
    """`column:value` of the columns that are not null, in column order."""
    if df is not None and (missing := [c for c in columns if c not in df.columns]):
        raise ValueError(f"unknown columns: {missing}")
    return F.array_compact(F.array(*[F.concat(F.lit(f"{c}:"), F.col(c).cast("string")) for c in columns]))


def matches_fully(c: Column, pattern: str) -> Column:
    return c.rlike(f"^(?:{pattern})$")


def hashed_column(c: Column, size: int) -> Column:
    """A column number below `size` for a phrase."""
    return F.pmod(F.hash(c), F.lit(size))


#: Units of memory sizes. Letters alone are powers of 1024, with i powers of 1000.
_UNITS = {"": 1, "k": 1024, "m": 1024**2, "g": 1024**3, "t": 1024**4, "ki": 1000, "mi": 1000**2, "gi": 1000**3, "ti": 1000**4}


def size_in_bytes(text: str) -> int:
    found = re.fullmatch(r"\s*([0-9.]+)\s*([kmgt]i?)?b?\s*", text.lower())
    if not found:
        raise ValueError(f"not a size: {text!r}")
    return int(float(found[1]) * _UNITS[found[2] or ""])
