"""Re-check a repaired table and compare it with the original."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..config import DEFAULT, Config
from ..functions import is_null
from ..operators.duplicates import exact_duplicates
from ..operators.outliers import fit_fences, outlier_counts
from ..operators.rows import col, field_types
from ..operators.scan import scan_table


def table_metrics(df: DataFrame) -> DataFrame:
    """(metric, value) rows: rows, columns, null cells, duplicate rows."""
    types = field_types(df)
    nulls = F.lit(0).cast("bigint")
    for c, t in types.items():
        nulls = nulls + is_null(col(c), t).cast("bigint")
    scan = df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(nulls), F.lit(0)).cast("bigint").alias("missing"))
    tall = scan.select(F.inline(F.array(
        F.struct(F.lit("rows").alias("metric"), F.col("rows").alias("value")),
        F.struct(F.lit("columns").alias("metric"), F.lit(len(types)).cast("bigint").alias("value")),
        F.struct(F.lit("missing").alias("metric"), F.col("missing").alias("value")))))
    copies = exact_duplicates(df).select(F.lit("duplicates").alias("metric"), F.col("n_duplicates").alias("value"))
    return tall.unionByName(copies)


def before_after(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row comparing the two tables."""
    both = (table_metrics(before).withColumn("side", F.lit("before"))
            .unionByName(table_metrics(after).withColumn("side", F.lit("after"))))
    pick = lambda m, s: F.max(F.when((F.col("metric") == m) & (F.col("side") == s), F.col("value")))
    wide = both.agg(*[pick(m, s).alias(f"{m}_{s}")
                      for m in ("rows", "columns", "missing", "duplicates") for s in ("before", "after")])
    return wide.select(
        "rows_before", "rows_after", (F.col("rows_before") - F.col("rows_after")).alias("rows_removed"),
        "columns_before", "columns_after",
        (F.col("columns_before") - F.col("columns_after")).alias("columns_removed"),
        "missing_before", "missing_after", "duplicates_before", "duplicates_after",
        F.round(F.col("rows_after") * 100.0 / F.greatest(F.col("rows_before"), F.lit(1)), 2)
        .alias("pct_data_retained"))


@dataclass
class Validation:
    loop: int
    info: dict
    missing: dict[str, int]
    broken: dict[str, int]
    outliers: dict[str, dict]
    before_after: dict
    issues_remain: bool

    def fingerprint(self) -> tuple:
        """What a further loop would have to change to be worth running."""
        return (tuple(sorted(self.missing.items())), tuple(sorted(self.broken.items())),
                tuple(sorted((c, v["n_iqr"], v["lower_fence"], v["upper_fence"])
                             for c, v in self.outliers.items())))


def metrics_of(df: DataFrame) -> dict[str, int]:
    return {r["metric"]: r["value"] for r in table_metrics(df).collect()}


def compare(before: dict[str, int], after: dict[str, int]) -> dict:
    # The names of the comparison's fields.
    return {"rows_before": before["rows"], "rows_after": after["rows"],
            "rows_removed": before["rows"] - after["rows"],
            "columns_before": before["columns"], "columns_after": after["columns"],
            "columns_removed": before["columns"] - after["columns"],
            "missing_before": before["missing"], "missing_after": after["missing"],
            "duplicates_before": before["duplicates"], "duplicates_after": after["duplicates"],
            "pct_data_retained": round(after["rows"] / max(before["rows"], 1) * 100, 2)}


def validate(before: DataFrame | dict, after: DataFrame, loop: int = 1, config: Config = DEFAULT,
             as_of=None) -> Validation:
    """Run the missing, broken and outlier detectors again and decide whether
    another loop is called for.

    ``before`` may be the metrics of the original table, so that a loop does
    not read it again.
    """
    data = after.drop(*[c for c in (config.near_duplicate_column,) if c in after.columns])
    scan = scan_table(data, config, as_of, formats=False)
    missing = {c: m["n_missing"] for c, m in scan.missing.items() if m["n_missing"]}
    broken = {f"{c}_{r}": n for (c, r), n in scan.broken.items()}
    fences = fit_fences(data, config, basics=scan.numeric)
    outliers = {r["column_name"]: r.asDict() for r in outlier_counts(data, config, fences=fences).collect()}
    now = {"rows": scan.n_rows, "columns": len(field_types(after)), "missing": scan.null_cells,
           "duplicates": exact_duplicates(after).first()["n_duplicates"]}
    original = before if isinstance(before, dict) else metrics_of(before)
    remain = bool(missing or broken or any(o["n_iqr"] for o in outliers.values()))
    facts = scan.info()
    facts["shape"] = (scan.n_rows, now["columns"])
    return Validation(loop, facts, missing, broken, outliers, compare(original, now), remain)


def quality_score(rows_before: int, rows_after: int) -> int:
    """Retained rows in percent."""
    return 100 if rows_before <= 0 else int(rows_after * 100 / rows_before + 0.5)
