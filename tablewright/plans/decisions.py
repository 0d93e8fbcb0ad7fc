"""Detected issues, and the repairs decided on as a table.

Everything here works on per-column summaries on the driver; its size is
bounded by the number of columns.  Near pairs stay a table.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from ..config import DEFAULT, Config
from ..operators.broken import broken_examples
from ..operators.categories import case_variants, variant_groups
from ..operators.duplicates import duplicate_rows, exact_duplicates
from ..operators.outliers import fit_fences, outlier_counts, outlier_examples
from ..operators.rows import ROW_ID
from ..operators.scan import TableScan, scan_table
from ..operators.similarity import near_pairs
from ..session import write_table


@dataclass
class Issues:
    """Summary of all detectors; at most a few entries per column."""

    scan: TableScan = field(default_factory=TableScan)
    n_rows: int = 0
    missing: dict[str, dict] = field(default_factory=dict)
    formats: dict[str, str] = field(default_factory=dict)
    broken: dict[str, dict] = field(default_factory=dict)
    exact_duplicates: int = 0
    duplicate_rows: list = field(default_factory=list)
    near_pairs: int = 0
    near_pairs_table: DataFrame | None = None
    near_pairs_shown: list[dict] = field(default_factory=list)
    contradictory: dict[str, dict] = field(default_factory=dict)
    outliers: dict[str, dict] = field(default_factory=dict)

    def counts(self) -> dict[str, int]:
        return {"missing": len(self.missing), "formats": len(self.formats),
                "broken": len(self.broken), "exact_duplicates": int(self.exact_duplicates > 0),
                "near_duplicates": int(self.near_pairs > 0),
                "contradictory": len(self.contradictory), "outliers": len(self.outliers)}

    @property
    def total(self) -> int:
        return sum(self.counts().values())


# Pairs that a text report shows; the table and the count hold all.
SHOWN_PAIRS = 30


def identify(df: DataFrame, config: Config = DEFAULT, as_of=None, examples: bool = False) -> Issues:
    """Run every detector and bring back the per-column summaries.

    Missing, format, broken and numeric summaries share one scan.  Row-level
    results stay on the cluster: only counts, labels and, on
    request, a fixed number of examples per issue are collected.
    """
    scan = scan_table(df, config, as_of)
    issues = Issues(scan=scan, n_rows=scan.n_rows)
    issues.missing = {c: m for c, m in scan.missing.items() if m["n_missing"]}
    issues.formats = {f"{c}_{check}": ", ".join(sorted(labels))
                      for (c, check), labels in scan.formats.items() if len(labels) > 1}
    issues.broken = {f"{c}_{r}": {"column": c, "rule": r, "count": n, "examples": []}
                     for (c, r), n in scan.broken.items()}
    issues.exact_duplicates = exact_duplicates(df).first()["n_duplicates"]
    pairs = issues.near_pairs_table = write_table(near_pairs(df, config=config))
    issues.near_pairs = pairs.count()
    if issues.near_pairs:
        best = pairs.orderBy(F.col("score").desc(), "column_name", "a", "b").limit(SHOWN_PAIRS)
        issues.near_pairs_shown = [r.asDict() for r in best.collect()]
    summary = (variant_groups(df).groupBy("column_name")
               .agg(F.count(F.lit(1)).alias("n_categories"), F.sum("n_variants").alias("n_variants")))
    for r in summary.collect():
        issues.contradictory[f"{r['column_name']}_case_inconsistencies"] = r.asDict()
    fences = fit_fences(df, config, basics=scan.numeric)
    for r in outlier_counts(df, config, fences=fences).collect():
        issues.outliers[r["column_name"]] = r.asDict()
    if examples:
        _add_examples(df, issues, config, as_of)
        if issues.outliers and ROW_ID in df.columns:
            only = {c: f for c, f in fences.items() if c in issues.outliers}
            for r in outlier_examples(df, config.examples, config=config, fences=only).collect():
                issues.outliers[r["column_name"]].setdefault("examples", []).append(r["value"])
    return issues


def _add_examples(df: DataFrame, issues: Issues, config: Config, as_of) -> None:
    if issues.broken and ROW_ID in df.columns:
        for r in broken_examples(df, config.examples, config, as_of).collect():
            key = f"{r['column_name']}_{r['rule']}"
            if key in issues.broken:
                issues.broken[key]["examples"].append(r["value"])
    if issues.exact_duplicates and ROW_ID in df.columns:
        issues.duplicate_rows = [r[ROW_ID] for r in duplicate_rows(df, 20).collect()]
    if issues.contradictory:
        names = [v["column_name"] for v in issues.contradictory.values()]
        best = variant_groups(df, names).orderBy(F.col("n_rows").desc(), "column_name", "category").limit(20)
        # Twenty categories at most, so the join side is bounded.
        shown = (case_variants(df, names, k=10)
                 .join(F.broadcast(best.select("column_name", "category")), ["column_name", "category"], "left_semi"))
        for r in shown.orderBy("column_name", "category", "variant").collect():
            entry = issues.contradictory[f"{r['column_name']}_case_inconsistencies"]
            entry.setdefault("examples", {}).setdefault(r["category"], []).append(r["variant"])


def decisions_frame(spark, actions) -> DataFrame:
    """(position, step, op, column_name, changed, retyped, evidence) of the
    actions that had an effect, in the order in which they ran.

    ``changed`` counts cells, rows or columns, whichever the action works on.
    """
    rows = [(i, a.step, a.op, a.column, a.changed, a.retyped, a.evidence())
            for i, a in enumerate(a for a in actions if a.effective)]
    return spark.createDataFrame(rows, "position int, step string, op string, column_name string, changed bigint, "
                                       "retyped string, evidence string")
