"""The whole workflow: profile, detect, fit repairs, apply exactly those, validate."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field, replace
from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from ..config import DEFAULT, Config
from ..operators.missing import missing_examples
from ..operators.profile import observe
from ..operators.repairs import Action, applied, apply_actions, measured
from ..operators.rows import ROW_ID, col, field_types, with_row_id
from ..session import write_table
from . import fitting
from .decisions import Issues, decisions_frame, identify
from .report import issue_report, narrative
from .validation import Validation, quality_score, validate


@dataclass
class CleaningPlan:
    """Fitted repairs in order; plain data."""

    actions: list[Action] = field(default_factory=list)

    def apply(self, df: DataFrame, config: Config = DEFAULT) -> DataFrame:
        """Run the same repairs on another table with the same columns."""
        return apply_actions(df, self.actions, config)

    def row_local(self) -> "CleaningPlan":
        """The part that needs no other rows: also valid on a stream."""
        return CleaningPlan([a for a in self.actions
                             if a.op not in ("drop_duplicates", "flag_near_duplicates")])


@dataclass
class CleanResult:
    df: DataFrame
    plan: CleaningPlan
    issues: Issues
    log: list[dict]
    validation: Validation
    report: str
    narrative: str
    source: DataFrame
    config: Config
    files: int = 1
    failures: list[tuple[str, str]] = field(default_factory=list)
    rejected: DataFrame | None = None

    @property
    def decisions(self) -> DataFrame:
        """The repairs that changed something, with what they changed."""
        return decisions_frame(self.source.sparkSession, self.plan.actions)

    def observe(self) -> dict[str, DataFrame]:
        """Profile of the table as it came in."""
        return observe(self.source, self.config)

    def summary(self) -> dict:
        """Exact counts of input, losses, findings and effects."""
        ba = self.validation.before_after
        effects = Counter()
        for a in self.plan.actions:
            if a.effective:
                effects[a.op] += a.changed or 0
        return {
            "input": {"files": self.files, "unreadable_files": len(self.failures),
                      "rejected_lines": self.rejected.count() if self.rejected is not None else 0},
            "rows": {"before": ba["rows_before"], "after": ba["rows_after"]},
            "columns": {"before": ba["columns_before"], "after": ba["columns_after"]},
            "null_cells": {"before": ba["missing_before"], "after": ba["missing_after"]},
            "issues": {**self.issues.counts(), "total": self.issues.total},
            "duplicate_rows": self.issues.exact_duplicates,
            "near_pairs": self.issues.near_pairs,
            "changed_by_repair": dict(effects),
            "validation_loops": self.validation.loop,
            "rows_kept_pct": quality_score(ba["rows_before"], ba["rows_after"])}


# Step name -> fit function.  The reference order fills gaps first; the other
# one normalises and removes impossible values before anything is imputed.
STEPS = {
    "fix_missing": fitting.fit_missing,
    "fix_nulls": fitting.fit_nulls,
    "fix_formats": fitting.fit_formats,
    "fix_broken_entries": fitting.fit_broken,
    "fix_text_consistency": fitting.fit_text_case,
    "fix_duplicates": fitting.fit_duplicates,
    "fix_column_names": fitting.fit_names,
}
ORDERS = {
    "reference": ("fix_missing", "fix_formats", "fix_broken_entries", "fix_text_consistency",
                  "fix_duplicates", "fix_column_names"),
    "repair_first": ("fix_nulls", "fix_formats", "fix_broken_entries", "fix_missing",
                     "fix_text_consistency", "fix_duplicates", "fix_column_names"),
}


def run_step(df: DataFrame, step: str, config: Config = DEFAULT) -> tuple[DataFrame, list[Action]]:
    """Fit one step on the table and return it repaired, still lazy."""
    actions = STEPS[step](df, config)
    return apply_actions(df, actions, config), actions


def fit_step(df: DataFrame, step: str, config: Config = DEFAULT, facts: dict | None = None) -> tuple[DataFrame, list[Action], dict]:
    """(repaired table, actions with what each changes, row and null-cell counts).

    A step with actions is written once, and counted by that job; ``facts``
    are the counts before, which a step without any, or that only renames, leaves as they are.
    """
    actions = STEPS[step](df, config)
    if facts is not None and all(a.op == "rename" for a in actions):
        return apply_actions(df, actions, config), measured(df, actions, config), facts
    return applied(df, actions, config, (facts or {}).get("rows"))


def decide(df: DataFrame, config: Config = DEFAULT, order_by: str | None = None) -> list[Action]:
    """The repairs that :func:`clean` makes in its first pass, fitted and measured."""
    current, actions, facts = write_table(with_row_id(df, order_by)), [], None
    for name in ORDERS[config.order]:
        current, fitted, facts = fit_step(current, name, config, facts)
        actions += fitted
    return actions


def fix_missing(df: DataFrame, config: Config = DEFAULT) -> DataFrame:
    return run_step(df, "fix_missing", config)[0]


def fix_formats(df: DataFrame, config: Config = DEFAULT) -> DataFrame:
    return run_step(df, "fix_formats", config)[0]


def fix_broken_entries(df: DataFrame, config: Config = DEFAULT) -> DataFrame:
    return run_step(df, "fix_broken_entries", config)[0]


def fix_text_consistency(df: DataFrame, config: Config = DEFAULT) -> DataFrame:
    return run_step(df, "fix_text_consistency", config)[0]


def fix_duplicates(df: DataFrame, config: Config = DEFAULT) -> DataFrame:
    return run_step(df, "fix_duplicates", config)[0]


def fix_column_names(df: DataFrame, config: Config = DEFAULT) -> DataFrame:
    return run_step(df, "fix_column_names", config)[0]


def _entry(step: str, before: DataFrame, after: DataFrame, actions: list[Action]) -> dict:
    """Log entry of a step: what it changed, by column."""
    done = [a for a in actions if a.effective]
    what = ", ".join(f"{op} {n}" for op, n in Counter({op: sum(a.changed or 0 for a in done if a.op == op) for op in dict.fromkeys(a.op for a in done)}).items())
    return {"step": step, "columns_before": len(field_types(before)), "columns_after": len(field_types(after)),
            "message": f"{step}: {what or 'no change'}",
            "changes": [{"op": a.op, "column": a.column, "changed": a.changed, "retyped": a.retyped, **a.params} for a in done],
            "timestamp": datetime.now().isoformat(timespec="seconds")}


def analyze(df: DataFrame, config: Config = DEFAULT, as_of=None, order_by: str | None = None):
    """Detect only: issues, report and overview; nothing is repaired."""
    df = with_row_id(df, order_by)
    issues = identify(df, config, as_of, examples=True)
    overview = issues.scan.info()
    examples: dict[str, list] = {}
    if issues.missing:
        only = df.select(ROW_ID, *[col(c) for c in issues.missing])
        for r in missing_examples(only, 3, config).collect():
            examples.setdefault(r["column_name"], []).append(r["value"])
    return issues, issue_report(issues, overview, examples)


def clean(df: DataFrame, config: Config = DEFAULT, order_by: str | None = None, as_of=None,
          recheck_steps: bool = False, files: int = 1, failures=(), rejected: DataFrame | None = None) -> CleanResult:
    """Run the full workflow on a table.

    Statistics reach the driver, rows never do.  The source is written once
    with its row ids, as Parquet below the checkpoint folder, and so is the
    result of each step that changes cells or rows; the many scans in between
    read single columns of those.  Each repair that is fitted is applied and logged with what it
    changed; nothing else is.  Validation loops run until nothing remains or
    nothing moves.  ``recheck_steps`` adds row and null counts to the log, which
    the jobs that write the steps have observed.
    """
    source = write_table(with_row_id(df, order_by))
    issues, report = analyze(source, config, as_of)
    original = {"rows": issues.n_rows, "columns": len(field_types(source)),
                "missing": issues.scan.null_cells, "duplicates": issues.exact_duplicates}
    plan, log = CleaningPlan(), []
    facts = {"rows": issues.n_rows, "missing_cells": issues.scan.null_cells}

    def step(frame: DataFrame, name: str) -> DataFrame:
        nonlocal facts
        out, actions, facts = fit_step(frame, name, config, facts)
        plan.actions += actions
        log.append(_entry(name, frame, out, actions) | (facts if recheck_steps else {}))
        return out

    current = source
    for name in ORDERS[config.order]:
        current = step(current, name)

    loop, seen = 1, set()
    checked = validate(original, current, loop, config, as_of)
    while checked.issues_remain and checked.fingerprint() not in seen:
        seen.add(checked.fingerprint())
        before = len(plan.actions)
        repaired = step(step(current, "fix_missing"), "fix_broken_entries")
        if not any(a.effective for a in plan.actions[before:]):
            # Nothing moved: what remains has no repair.
            break
        loop += 1
        current = repaired
        checked = validate(original, current, loop, config, as_of)

    return CleanResult(current.drop(ROW_ID), plan, issues, log, checked, report,
                       narrative(plan.actions, checked, len(failures)), source, config, files, list(failures), rejected)
