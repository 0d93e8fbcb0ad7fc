"""Exact duplicates: whole rows and key-like columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..config import DEFAULT, KEY_WORDS, Config
from .rows import ROW_ID, col, field_types, groupable, value_counts


def _data(df: DataFrame) -> list:
    return [col(c) for c in field_types(df)]


def exact_duplicates(df: DataFrame) -> DataFrame:
    """One row: how many rows repeat an earlier one, and in how many groups.

    Row hashes are counted first, per task before the shuffle; whole rows are
    compared only where 128 bits of hash agree.
    """
    flat = groupable(df)
    hashed = flat.select(F.xxhash64(*_data(flat)).alias("_h1"), F.xxhash64(F.lit(1), *_data(flat)).alias("_h2"), *_data(flat))
    keys = hashed.groupBy("_h1", "_h2").agg(F.count(F.lit(1)).alias("_n"))
    alone = keys.filter("_n = 1").agg(F.count(F.lit(1)).alias("_k")).select(F.lit(1).cast("bigint").alias("_n"), F.col("_k"))
    repeated = (hashed.join(keys.filter("_n > 1").select("_h1", "_h2"), ["_h1", "_h2"], "left_semi")
                .groupBy(*_data(flat)).agg(F.count(F.lit(1)).cast("bigint").alias("_n")))
    return (repeated.groupBy("_n").agg(F.count(F.lit(1)).alias("_k")).unionByName(alone)
            .agg(F.coalesce(F.sum(F.col("_n") * F.col("_k")), F.lit(0)).cast("bigint").alias("n_rows"),
                 F.coalesce(F.sum((F.col("_n") - 1) * F.col("_k")), F.lit(0)).cast("bigint").alias("n_duplicates"),
                 F.coalesce(F.sum(F.when(F.col("_n") > 1, F.col("_k"))), F.lit(0)).cast("bigint").alias("n_duplicate_groups")))


def approximate_duplicates(df: DataFrame, rsd: float = 0.01) -> DataFrame:
    """Estimated duplicate rows from a distinct-count sketch; no shuffle of rows."""
    row_hash = F.xxhash64(*_data(groupable(df)))
    return (df.agg(F.count(F.lit(1)).alias("n_rows"),
                   F.approx_count_distinct(row_hash, rsd).alias("n_distinct"))
            .select("n_rows", F.greatest(F.col("n_rows") - F.col("n_distinct"), F.lit(0))
                    .alias("n_duplicates")))


def duplicate_rows(df: DataFrame, k: int = 20) -> DataFrame:
    """The first k rows, in row order, that have an identical twin anywhere.

    Those rows lie in the k duplicate groups with the smallest first row id:
    any other group starts after k qualifying rows.  So at most k group keys
    are broadcast back against the table.
    """
    names = list(field_types(df))
    flat = groupable(df)
    groups = (flat.groupBy(*_data(df))
              .agg(F.count(F.lit(1)).alias("_n"), F.min(ROW_ID).alias("_first"))
              .filter("_n > 1").orderBy("_first").limit(k)
              .select(*[col(c).alias(f"_k{i}") for i, c in enumerate(names)]))
    same = F.lit(True)
    for i, c in enumerate(names):
        same = same & col(c).eqNullSafe(F.col(f"_k{i}"))
    return (flat.join(F.broadcast(groups), same, "left_semi")
            .orderBy(ROW_ID).limit(k).select(ROW_ID, *_data(df)))


def key_columns(df: DataFrame, config: Config = DEFAULT) -> list[str]:
    return [c for c in field_types(df) if config.has_role(c, KEY_WORDS)]


def key_repeats(df: DataFrame, config: Config = DEFAULT, columns=None) -> DataFrame:
    """Values that occur more than once in columns expected to be unique."""
    columns = key_columns(df, config) if columns is None else list(columns)
    return value_counts(df, columns).filter("value IS NOT NULL AND n > 1")


def drop_duplicates(df: DataFrame) -> DataFrame:
    """Keep one copy of each row; with a row id, the smallest id survives.

    A hash aggregate with partial combine: hot rows collapse before the
    shuffle.
    """
    names = list(field_types(df))
    flat = groupable(df)
    if flat.schema != df.schema:
        # Maps cannot be grouped, so their text is and the first map returns.
        types = field_types(df)
        keys = [col(c).alias(f"_k{i}") for i, c in enumerate(names)]
        both = flat.select(*keys).columns
        wide = df.select("*", *[F.to_json(col(c)).alias(f"_k{i}") if flat.schema[c].dataType != types[c]
                                else col(c).alias(f"_k{i}") for i, c in enumerate(names)])
        picks = [F.first(col(c)).alias(c) for c in names]
        if ROW_ID in df.columns:
            picks = [F.min(ROW_ID).alias(ROW_ID)] + picks
        return wide.groupBy(*both).agg(*picks).select(*[col(c) for c in df.columns])
    if ROW_ID in df.columns:
        return (df.groupBy(*[col(c) for c in names]).agg(F.min(ROW_ID).alias(ROW_ID))
                .select(*[col(c) for c in df.columns]))
    return df.distinct()
