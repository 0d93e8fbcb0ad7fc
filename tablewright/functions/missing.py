"""Predicates for the three notions of a missing cell."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

from .text import as_text, strip


def is_null(c: Column, dtype: T.DataType) -> Column:
    """NULL, or NaN for floating point columns."""
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def is_blank(c: Column, dtype: T.DataType) -> Column:
    """Text that is empty after stripping; never NULL."""
    if not isinstance(dtype, T.StringType):
        return F.lit(False)
    return F.coalesce(strip(c) == "", F.lit(False))


def is_placeholder(c: Column, dtype: T.DataType, tokens) -> Column:
    """A word that stands for "no value"; never NULL."""
    if isinstance(dtype, T.StringType):
        key = F.lower(strip(c))
    elif isinstance(dtype, T.DateType):
        key = as_text(c, dtype)
    else:
        return F.lit(False)
    return F.coalesce(key.isin(*tokens), F.lit(False))


def is_missing(c: Column, dtype: T.DataType, tokens) -> Column:
    """NULL, blank or placeholder."""
    if not isinstance(dtype, (T.StringType, T.DateType)):
        return is_null(c, dtype)
    return is_null(c, dtype) | is_blank(c, dtype) | is_placeholder(c, dtype, tokens)


def null_out(c: Column, dtype: T.DataType, tokens, blanks: bool = False) -> Column:
    """Empty strings and placeholders become NULL, NaN becomes NULL.

    With ``blanks`` whitespace-only text becomes NULL as well.
    """
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(c), c)
    if isinstance(dtype, T.StringType):
        empty = (strip(c) == "") if blanks else (c == "")
        return F.when(~(is_placeholder(c, dtype, tokens) | empty), c)
    if isinstance(dtype, T.DateType):
        return F.when(~is_placeholder(c, dtype, tokens), c)
    return c
