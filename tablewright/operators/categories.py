"""Spellings of one category that differ only in case or outer whitespace."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import strip
from .rows import field_types, string_columns, value_counts


def _keyed(df: DataFrame, columns, trim: bool) -> DataFrame:
    columns = string_columns(df) if columns is None else list(columns)
    value = strip(F.col("value")) if trim else F.col("value")
    return (value_counts(df, columns).filter(F.col("value").isNotNull())
            .withColumn("category", F.lower(value)))


def variant_groups(df: DataFrame, columns=None, trim: bool = True) -> DataFrame:
    """Categories with several spellings: how many, and over how many rows."""
    return (_keyed(df, columns, trim).groupBy("column_name", "category")
            .agg(F.count(F.lit(1)).alias("n_variants"), F.sum("n").alias("n_rows"))
            .filter("n_variants > 1"))


def case_variants(df: DataFrame, columns=None, trim: bool = True, k: int | None = None) -> DataFrame:
    """(column_name, category, variant, n) for every category with several spellings.

    Variants stay rows; nothing is collected per category.  ``k`` keeps the
    first k spellings of each category.
    """
    keyed = _keyed(df, columns, trim)
    several = (keyed.groupBy("column_name", "category").agg(F.count(F.lit(1)).alias("_v"))
               .filter("_v > 1").select("column_name", "category"))
    out = (keyed.join(several, ["column_name", "category"], "left_semi")
           .select("column_name", "category", F.col("value").alias("variant"), "n"))
    if k is not None:
        w = Window.partitionBy("column_name", "category").orderBy("variant")
        out = (out.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= k).drop("_rank"))
    return out


def canonical_spelling(df: DataFrame, columns=None, trim: bool = True) -> DataFrame:
    """Most frequent spelling of each category with several; ties by value."""
    best = F.min_by("value", F.struct(-F.col("n"), F.col("value")))
    return (_keyed(df, columns, trim).groupBy("column_name", "category")
            .agg(best.alias("canonical"), F.count(F.lit(1)).alias("_v"))
            .filter("_v > 1").drop("_v"))


def apply_canonical_spelling(df: DataFrame, column: str, trim: bool = True) -> DataFrame:
    """Rewrite one column to the most frequent spelling of each category.

    The mapping has a row per category with several spellings.  Spark
    broadcasts it when its measured size allows and shuffles otherwise; in
    the shuffled case the adaptive skew join splits hot categories.
    """
    from .rows import col

    assert column in field_types(df)
    key = F.lower(strip(col(column)) if trim else col(column))
    names = df.columns
    mapping = canonical_spelling(df, [column], trim).select(
        F.col("category").alias("_category"), F.col("canonical").alias("_canonical"))
    return (df.join(mapping, key == F.col("_category"), "left")
            .select(*[F.coalesce(F.col("_canonical"), col(c)).alias(c) if c == column else col(c)
                      for c in names]))
