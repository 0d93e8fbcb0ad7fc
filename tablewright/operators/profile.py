"""Read-only observation of a table: shape, types, statistics, frequencies."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..config import DEFAULT, Config
from ..functions import as_text, is_null
from .quantiles import quantiles
from .rows import (ROW_ID, aggregate_row, col, field_types, first_cells, is_numeric,
                   tall_aggregates, value_counts)


# Bytes per value of the fixed-width types; 8 for all others.
WIDTHS = {T.BooleanType: 1, T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4,
          T.FloatType: 4, T.DateType: 4}


def type_histogram(df: DataFrame) -> dict[str, int]:
    """How many columns have each type; metadata only."""
    return dict(Counter(t.simpleString() for t in field_types(df).values()))


def text_bytes(df: DataFrame):
    """Aggregate: logical bytes of the table.

    Text counts its encoded length, nested values their JSON length, and
    everything else the fixed width of its type.
    """
    total = F.lit(0).cast("bigint")
    for name, dtype in field_types(df).items():
        if isinstance(dtype, (T.StringType, T.BinaryType)):
            size = F.coalesce(F.octet_length(col(name)), F.lit(0))
        elif isinstance(dtype, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
            size = F.coalesce(F.octet_length(F.to_json(col(name))), F.lit(0))
        else:
            size = F.when(col(name).isNotNull(), F.lit(WIDTHS.get(type(dtype), 8))).otherwise(F.lit(0))
        total = total + size.cast("bigint")
    return F.sum(total)


def shape(df: DataFrame) -> DataFrame:
    """One row: rows, columns, cells, logical text bytes, type histogram."""
    n_cols = len(field_types(df))
    types = ", ".join(f"{t}:{n}" for t, n in sorted(type_histogram(df).items()))
    return (df.agg(F.count(F.lit(1)).alias("n_rows"),
                   F.coalesce(text_bytes(df), F.lit(0)).cast("bigint").alias("text_bytes"))
            .select("n_rows", F.lit(n_cols).cast("bigint").alias("n_columns"),
                    (F.col("n_rows") * n_cols).alias("n_cells"),
                    "text_bytes", F.lit(types).alias("types")))


def head_tail(df: DataFrame, n: int = 5) -> DataFrame:
    """First and last rows by row id, marked ``head`` / ``tail``.

    Both ends are top-n selections, so no full sort takes place.
    """
    head = df.orderBy(F.col(ROW_ID).asc()).limit(n).withColumn("part", F.lit("head"))
    tail = df.orderBy(F.col(ROW_ID).desc()).limit(n).withColumn("part", F.lit("tail"))
    return head.unionByName(tail)


def null_profile(df: DataFrame) -> DataFrame:
    """Non-null count, null count and null share per column, one scan."""
    rows = []
    for name, dtype in field_types(df).items():
        null = F.count_if(is_null(col(name), dtype))
        n = F.count(F.lit(1))
        rows.append(((name, dtype.simpleString()), {
            "non_null": n - null, "null_count": null,
            "null_pct": F.when(n > 0, F.round(null * 100.0 / n, 2))}))
    return tall_aggregates(df, rows, [("column_name", "string"), ("data_type", "string")],
                           [("non_null", "bigint"), ("null_count", "bigint"), ("null_pct", "double")])


def distinct_counts(df: DataFrame, columns=None, approximate: bool = False) -> DataFrame:
    """Distinct non-null values per column.

    Exact counts shuffle each distinct value once; ``approximate`` keeps a
    fixed-size sketch per column instead and shuffles nothing else.
    """
    types = field_types(df)
    columns = list(columns or types)
    if approximate:
        rows = [((c,), {"unique_count": F.approx_count_distinct(as_text(col(c), types[c]))})
                for c in columns]
        return tall_aggregates(df, rows, [("column_name", "string")], [("unique_count", "bigint")])
    counted = (value_counts(df, columns)
               .groupBy("column_name")
               .agg(F.count("value").alias("unique_count")))
    return counted


def top_values(df: DataFrame, k: int = 3, columns=None) -> DataFrame:
    """The k most frequent values of each non-numeric column; ties by value.

    The rank filter lets Spark keep only k rows per column on the map side,
    so no column's distinct values gather in one task.
    """
    if columns is None:
        columns = [c for c, t in field_types(df).items() if not is_numeric(t)]
    w = Window.partitionBy("column_name").orderBy(F.col("n").desc(), F.col("value"))
    return (value_counts(df, columns).filter(F.col("value").isNotNull())
            .withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .select("column_name", "rank", "value", "n"))


def sample_values(df: DataFrame, k: int = 5, columns=None) -> DataFrame:
    """First k non-null values of each column in row order; one scan."""
    types = field_types(df)
    return first_cells(df, {c: ~is_null(col(c), types[c]) for c in (columns or types)}, k)


def numeric_values(df: DataFrame, columns=None) -> dict:
    """Double expression per numeric column with NaN turned into NULL."""
    types = field_types(df)
    out = {}
    for c in (columns if columns is not None else types):
        if is_numeric(types[c]):
            v = col(c).cast("double")
            out[c] = F.when(~F.isnan(v), v) if isinstance(types[c], (T.DoubleType, T.FloatType)) else v
    return out


def numeric_profile(df: DataFrame, config: Config = DEFAULT, columns=None,
                    approximate: bool = False) -> DataFrame:
    """Min, max, mean, median and sample deviation per numeric column.

    Medians are exact unless ``approximate``; they are found first, one number
    per column, and enter the final one-scan aggregate as constants.
    """
    values = numeric_values(df, columns)
    medians = {}
    if not approximate:
        counts = aggregate_row(df, [F.count(v).alias(c) for c, v in values.items()]) if values else {}
        medians = quantiles(df, values, [0.5], counts, config.exact_quantile_rows)
    rows = []
    for c, v in values.items():
        median = (F.approx_percentile(v, 0.5, 10_000) if approximate
                  else F.max(F.lit(medians[c][0]).cast("double")))
        rows.append(((c,), {
            "min": F.round(F.min(v), 4), "max": F.round(F.max(v), 4),
            "mean": F.round(F.avg(v), 4), "median": F.round(median, 4),
            "std": F.round(F.stddev_samp(v), 4)}))
    return tall_aggregates(df, rows, [("column_name", "string")],
                           [(m, "double") for m in ("min", "max", "mean", "median", "std")])


def info(df: DataFrame) -> dict:
    """Shape, types, text bytes and non-null counts; one scan."""
    types = field_types(df)
    aggregates = [F.count(F.lit(1)).alias("n_rows"),
                  F.coalesce(text_bytes(df), F.lit(0)).alias("text_bytes")]
    aggregates += [F.count_if(~is_null(col(c), t)).alias(f"c{i}") for i, (c, t) in enumerate(types.items())]
    row = aggregate_row(df, aggregates)
    return {"shape": (row["n_rows"], len(types)),
            "dtypes": {c: t.simpleString() for c, t in types.items()},
            "text_bytes": row["text_bytes"],
            "non_null": {c: row[f"c{i}"] for i, c in enumerate(types)}}


def observe(df: DataFrame, config: Config = DEFAULT) -> dict[str, DataFrame]:
    """All profiling tables, keyed by name."""
    types = field_types(df)
    out = {"shape": shape(df), "nulls": null_profile(df), "distinct": distinct_counts(df),
           "top_values": top_values(df)}
    if any(is_numeric(t) for t in types.values()):
        out["numeric"] = numeric_profile(df, config)
    if ROW_ID in df.columns:
        out["head_tail"] = head_tail(df)
        out["samples"] = sample_values(df, config.examples)
    return out
