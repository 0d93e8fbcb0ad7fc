"""Detection of missing cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..config import DEFAULT, Config
from ..functions import as_text, is_blank, is_missing, is_null, is_placeholder
from .rows import col, field_types, first_cells, tall_aggregates

MISSING_METRICS = [("n_rows", "bigint"), ("n_null", "bigint"), ("n_blank", "bigint"),
                   ("n_placeholder", "bigint"), ("n_placeholder_or_null", "bigint"),
                   ("n_missing", "bigint"), ("pct_missing", "double")]


def missing_aggregates(df: DataFrame, config: Config = DEFAULT):
    rows = []
    n = F.count(F.lit(1))
    for name, dtype in field_types(df).items():
        c = col(name)
        null = F.count_if(is_null(c, dtype))
        placeholder = F.count_if(is_placeholder(c, dtype, config.placeholders))
        missing = F.count_if(is_missing(c, dtype, config.placeholders))
        rows.append(((name,), {
            "n_rows": n, "n_null": null,
            "n_blank": F.count_if(is_blank(c, dtype)),
            "n_placeholder": placeholder, "n_placeholder_or_null": placeholder + null,
            "n_missing": missing,
            "pct_missing": F.when(n > 0, F.round(missing * 100.0 / n, 2))}))
    return rows


def missing_profile(df: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Null, blank, placeholder and total missing counts per column, one scan."""
    return tall_aggregates(df, missing_aggregates(df, config),
                           [("column_name", "string")], MISSING_METRICS)


def missing_examples(df: DataFrame, k: int = 3, config: Config = DEFAULT) -> DataFrame:
    """Up to k raw missing values per column in row order (NULL included); one scan."""
    return first_cells(df, {c: is_missing(col(c), t, config.placeholders) for c, t in field_types(df).items()}, k)
