"""Text expressions, all built-in Catalyst functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

# Every character Python's str.strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(c: Column) -> Column:
    """Remove leading and trailing whitespace of every kind (F.trim: spaces only)."""
    return F.btrim(c, F.lit(WHITESPACE))


def ascii_fold(c: Column) -> Column:
    """Drop every non-ASCII character, then strip."""
    return strip(F.regexp_replace(c, r"[^\x00-\x7F]+", ""))


def title_case(c: Column) -> Column:
    """Capitalise the first letter of every run of letters (``O'Brien 3Rd``).

    ``initcap`` only looks at blanks, so the text is split where a letter
    follows a non-letter and each piece gets its first character raised.
    """
    pieces = F.split(F.lower(c), r"(?<!\p{L})(?=\p{L})")
    return F.array_join(
        F.transform(pieces, lambda w: F.concat(F.upper(F.left(w, F.lit(1))),
                                               F.substr(w, F.lit(2)))), "")


def token_sort_key(c: Column) -> Column:
    """Lower-cased words in sorted order: the form in which names are compared.

    Characters of the Latin-1 upper half are dropped first and anything that
    is neither letter, digit nor underscore separates words.
    """
    words = F.split(
        F.regexp_replace(F.lower(F.regexp_replace(c, r"[\x{80}-\x{FF}]+", "")),
                         r"[^\p{L}\p{N}_]+", " "), " ")
    return F.array_join(F.array_sort(F.filter(words, lambda w: w != "")), " ")


def as_text(c: Column, dtype: T.DataType) -> Column:
    """Text of a value as the detectors see it, for any column type."""
    if isinstance(dtype, T.StringType):
        return c
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        # 5551234567.0 rather than 5.551234567E9; adding zero folds -0.0.
        d = c.cast("double") + F.lit(0.0)
        plain = (F.abs(d) < 1e15) & (d == F.floor(d))
        return (F.when(F.isnan(d), F.lit(None).cast("string"))
                .when(plain, F.concat(d.cast("decimal(20,0)").cast("string"), F.lit(".0")))
                .otherwise(d.cast("string")))
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(c)
    if isinstance(dtype, T.BinaryType):
        return F.hex(c)
    return c.cast("string")
