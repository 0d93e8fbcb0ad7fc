"""Outliers of numeric columns by z-score and by quartile fences."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from ..config import DEFAULT, SKIP_OUTLIER_WORDS, Config
from .profile import numeric_values
from .quantiles import quantiles
from .rows import ROW_ID, aggregate_row, tall_aggregates


@dataclass(frozen=True)
class Fences:
    """What one pass over a numeric column yields; a few numbers per column."""

    n: int
    mean: float
    std: float
    q1: float
    q3: float
    lower: float
    upper: float


def fit_fences(df: DataFrame, config: Config = DEFAULT, columns=None,
               basics: dict[str, dict] | None = None) -> dict[str, Fences]:
    """Statistics of every numeric column with enough values.

    ``basics`` may carry count, mean and deviation from an earlier scan.
    """
    values = numeric_values(df, columns)
    if not values:
        return {}
    if basics is None:
        aggregates = []
        for i, v in enumerate(values.values()):
            aggregates += [F.count(v).alias(f"n{i}"), F.avg(v).alias(f"m{i}"), F.stddev_pop(v).alias(f"s{i}")]
        row = aggregate_row(df, aggregates)
        basics = {c: {"n": row[f"n{i}"], "mean": row[f"m{i}"], "std": row[f"s{i}"]}
                  for i, c in enumerate(values)}
    counts = {c: basics[c]["n"] for c in values if basics[c]["n"] >= max(1, config.min_outlier_rows)}
    quartiles = quantiles(df, {c: values[c] for c in counts}, [0.25, 0.75], counts,
                          config.exact_quantile_rows)
    out = {}
    for c, n in counts.items():
        q1, q3 = quartiles[c]
        reach = config.iqr_multiplier * (q3 - q1)
        out[c] = Fences(n, basics[c]["mean"], basics[c]["std"], q1, q3, q1 - reach, q3 + reach)
    return out


def is_z_outlier(v, f: Fences, config: Config):
    if not f.std or f.std != f.std:
        return F.lit(False)
    return F.coalesce(F.abs((v - F.lit(f.mean)) / F.lit(f.std)) > config.z_threshold, F.lit(False))


def is_iqr_outlier(v, f: Fences):
    return F.coalesce((v < F.lit(f.lower)) | (v > F.lit(f.upper)), F.lit(False))


def outlier_counts(df: DataFrame, config: Config = DEFAULT, columns=None,
                   fences: dict[str, Fences] | None = None) -> DataFrame:
    """Outliers per column under both rules; columns without any are left out.

    The fences enter as constants, so this is one more scan and no join.
    """
    fences = fit_fences(df, config, columns) if fences is None else fences
    values = numeric_values(df, list(fences))
    rows = []
    for c, f in fences.items():
        const = lambda x: F.max(F.round(F.lit(x), 4))
        rows.append(((c,), {
            "n_z": F.count_if(is_z_outlier(values[c], f, config)),
            "n_iqr": F.count_if(is_iqr_outlier(values[c], f)),
            "lower_fence": const(f.lower), "upper_fence": const(f.upper),
            "skipped_by_name": F.max(F.lit(config.has_role(c, SKIP_OUTLIER_WORDS)))}))
    return tall_aggregates(
        df, rows, [("column_name", "string")],
        [("n_z", "bigint"), ("n_iqr", "bigint"), ("lower_fence", "double"),
         ("upper_fence", "double"), ("skipped_by_name", "boolean")]).filter("n_z > 0 OR n_iqr > 0")


def outlier_rows(df: DataFrame, rule: str = "iqr", config: Config = DEFAULT, columns=None,
                 fences: dict[str, Fences] | None = None) -> DataFrame:
    """(column_name, _row_id, value) of every outlier; no shuffle."""
    fences = fit_fences(df, config, columns) if fences is None else fences
    values = numeric_values(df, list(fences))
    test = (lambda c: is_iqr_outlier(values[c], fences[c])) if rule == "iqr" \
        else (lambda c: is_z_outlier(values[c], fences[c], config))
    if not fences:
        return df.sparkSession.createDataFrame([], f"column_name string, {ROW_ID} bigint, value double")
    cells = F.array(*[F.when(test(c), F.struct(F.lit(c).alias("column_name"), values[c].alias("value")))
                      for c in fences])
    return (df.select(ROW_ID, F.explode(F.filter(cells, lambda x: x.isNotNull())).alias("v"))
            .select("v.column_name", ROW_ID, "v.value"))


def outlier_examples(df: DataFrame, k: int = 5, rule: str = "iqr", config: Config = DEFAULT,
                     fences: dict[str, Fences] | None = None) -> DataFrame:
    """First k outliers per column in row order."""
    w = Window.partitionBy("column_name").orderBy(ROW_ID)
    return (outlier_rows(df, rule, config, fences=fences).withColumn("rank", F.row_number().over(w))
            .filter(F.col("rank") <= k).select("column_name", "rank", ROW_ID, "value"))
