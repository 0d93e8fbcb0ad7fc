"""Row-local and table-level repairs, each a lazy DataFrame -> DataFrame step.

A repair is described by an :class:`Action`: which operation, on which column,
with which fitted parameters.  Actions are plain data, so a list of them is a
plan that can be logged, stored, re-applied to new rows or to a stream.
"""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, field, replace
from datetime import datetime

from pyspark.sql import Column, DataFrame, Observation, functions as F, types as T

from ..config import DEFAULT, EMAIL_PATTERN, PHONE_PATTERN, Config
from ..functions import (ascii_fold, as_text, is_null, iso_day, null_out, parse_date,
                         strip, strip_to_number, title_case)
from ..session import write_table
from .broken import as_number, out_of_range
from .duplicates import drop_duplicates
from .rows import AGGREGATES_PER_PASS, aggregate_row, col, expression, field_types, is_temporal
from .similarity import flag_near_duplicates


@dataclass(frozen=True)
class Action:
    step: str
    op: str
    column: str | None = None
    params: dict = field(default_factory=dict)
    # Measured when the action is applied: cells, rows or columns that it
    # changes, and the type before and after if that changes too.
    changed: int | None = None
    retyped: str = ""
    decided_at: str = field(default_factory=lambda: datetime.now().isoformat(timespec="seconds"))

    @property
    def effective(self) -> bool:
        return bool(self.changed or self.retyped)

    def as_dict(self) -> dict:
        return asdict(self)

    def evidence(self) -> str:
        """What the fit measured and chose, as JSON."""
        return json.dumps({k: v for k, v in self.params.items() if k not in ("tokens", "names")}, sort_keys=True, default=str)


def clip(c: Column, lower: float, upper: float) -> Column:
    """Move values to the nearer fence; NULL stays NULL."""
    c = c.cast("double")
    return F.when(c.isNotNull(), F.greatest(F.lit(lower), F.least(F.lit(upper), c)))


def _fill(c: Column, dtype: T.DataType, p: dict) -> Column:
    value = p["value"]
    if p.get("kind") == "number":
        return F.coalesce(c.cast("double"), F.lit(float(value)))
    if p.get("kind") == "micros":
        return F.coalesce(c, F.timestamp_micros(F.lit(value).cast("bigint")).cast(dtype))
    return F.coalesce(c, F.lit(value).cast(dtype))


def _to_date(c: Column, dtype: T.DataType, p: dict) -> Column:
    ts = c.cast("timestamp_ntz") if is_temporal(dtype) else parse_date(as_text(c, dtype))
    return iso_day(ts) if p.get("as_text", True) else ts


def _text_only(fn):
    return lambda c, t, p: fn(c) if isinstance(t, T.StringType) else c


# Row-local operations: (column, type, parameters) -> column.
COLUMN_OPS = {
    "null_placeholders": lambda c, t, p: null_out(c, t, p["tokens"], p.get("blanks", False)),
    "fill": _fill,
    "fold_ascii": _text_only(lambda c: F.nullif(ascii_fold(c), F.lit("nan"))),
    "strip": _text_only(lambda c: F.nullif(strip(c), F.lit("nan"))),
    "to_date": _to_date,
    "to_number": lambda c, t, p: strip_to_number(as_text(c, t)),
    "null_age": lambda c, t, p: F.when(~F.coalesce(out_of_range(c.cast("double"), tuple(p["range"])), F.lit(False)), c),
    "null_email": lambda c, t, p: F.when(as_text(c, t).rlike(EMAIL_PATTERN), c),
    "null_phone": lambda c, t, p: F.when(as_text(c, t).rlike(PHONE_PATTERN), c),
    "null_bad_date": lambda c, t, p: c if is_temporal(t) else F.when(parse_date(as_text(c, t)).isNotNull(), c),
    "rule": lambda c, t, p: F.when(~F.coalesce(expression(p["condition"], p["column"]), F.lit(False)) | is_null(c, t), c).otherwise(expression(p["repair"], p["column"]).cast(t)),
    "cap": lambda c, t, p: clip(c, p["lower"], p["upper"]),
    "title": _text_only(title_case),
    "lower": _text_only(F.lower),
    "to_long": lambda c, t, p: c.cast("bigint"),
}
ROW_OPS = ("drop_duplicates", "flag_near_duplicates")


def differs(before: Column, after: Column, types: tuple[T.DataType, T.DataType]) -> Column:
    """True where a repair changed a cell; numbers compare as numbers."""
    if all(isinstance(t, T.NumericType) for t in types):
        return ~before.cast("double").eqNullSafe(after.cast("double"))
    return ~as_text(before, types[0]).eqNullSafe(as_text(after, types[1]))


def _with_counts(actions, marks: dict[int, tuple[str, str]], counts: dict) -> list[Action]:
    out = []
    for a in actions:
        if id(a) in marks:
            mark, retyped = marks[id(a)]
            a = replace(a, changed=counts[mark], retyped=retyped)
        elif a.op == "rename":
            a = replace(a, changed=sum(old != new for old, new in a.params["names"].items()))
        elif a.op == "drop_column":
            a = replace(a, changed=1)
        out.append(a)
    return out


def measured(df: DataFrame, actions, config: Config = DEFAULT) -> list[Action]:
    """The actions with the number of cells or columns that each changes.

    One scan for all column actions.  Actions that remove or flag rows are
    measured where their result is stored.
    """
    marks: dict[int, tuple[str, str]] = {}
    wide = apply_actions(df, [a for a in actions if a.op not in ROW_OPS], config, marks)
    row = aggregate_row(wide, [F.count_if(F.col(m)).alias(m) for m, _ in marks.values()]) if marks else {}
    return _with_counts(actions, marks, row)


def applied(df: DataFrame, actions, config: Config = DEFAULT, rows_before: int | None = None) -> tuple[DataFrame, list[Action], dict]:
    """(repaired table, actions with what they changed, its row and null-cell counts).

    The table is written once; what the actions changed and what the table
    then holds is observed by the job that writes it, so nothing is scanned
    for the counts.
    """
    marks: dict[int, tuple[str, str]] = {}
    by_row = any(a.op in ROW_OPS for a in actions)
    wide = apply_actions(df, actions, config, None if by_row else marks)
    found = [m for m, _ in marks.values()]
    names = [c for c in wide.columns if c not in found]
    types, flag = field_types(wide), config.near_duplicate_column
    flagged = F.count_if(F.coalesce(col(flag), F.lit(False)) if by_row and flag in names else F.lit(False))
    metrics = [F.count(F.lit(1)).alias("rows"), flagged.alias("flagged"), *[F.count_if(F.col(m)).alias(m) for m in found],
               *[F.count_if(is_null(col(c), types[c])).alias(f"null{i}") for i, c in enumerate(n for n in names if n in types)]]
    seen = []
    for i in range(0, len(metrics), AGGREGATES_PER_PASS):
        seen.append(Observation())
        wide = wide.observe(seen[-1], *metrics[i:i + AGGREGATES_PER_PASS])
    out = write_table(wide.select(*[col(c) for c in names]))
    counts: dict = {}
    for o in seen:
        counts.update(o.get)
    done = _with_counts(actions, marks, counts)
    if by_row:
        removed = (df.count() if rows_before is None else rows_before) - counts["rows"]
        done = [replace(a, changed={"drop_duplicates": removed, "flag_near_duplicates": counts["flagged"]}.get(a.op, a.changed)) for a in done]
    return out, done, {"rows": counts["rows"], "missing_cells": sum(v for k, v in counts.items() if k.startswith("null"))}


def apply_actions(df: DataFrame, actions, config: Config = DEFAULT, marks: dict | None = None) -> DataFrame:
    """Run actions in order; neighbouring column actions share a projection.

    A column touched again starts a new projection, which keeps expression
    trees small; Catalyst merges projections where that costs nothing.  With
    ``marks`` each column action leaves a boolean column that tells which
    cells it changed; its name and the change of type are noted there.
    """
    pending: dict[str, tuple[Action, Column]] = {}
    kept: list[str] = []

    def flush(frame: DataFrame) -> DataFrame:
        if not pending:
            return frame
        columns = [c for c in frame.columns if c not in kept]
        new = {c: e for c, (_, e) in pending.items()}
        if marks is None:
            out = frame.select(*[new[c].alias(c) if c in new else col(c) for c in columns])
        else:
            before = field_types(frame)
            both = frame.select(*[col(c) for c in frame.columns], *[e.alias(f"_after_{c}") for c, e in new.items()])
            extra = []
            for c, (a, _) in pending.items():
                after = both.schema[f"_after_{c}"].dataType
                name = f"_mark{len(marks)}"
                retyped = "" if after == before[c] else f"{before[c].simpleString()} -> {after.simpleString()}"
                marks[id(a)] = (name, retyped)
                extra.append(differs(col(c), col(f"_after_{c}"), (before[c], after)).alias(name))
            out = both.select(*[col(f"_after_{c}").alias(c) if c in new else col(c) for c in columns], *[col(m) for m in kept], *extra)
            kept.extend(m for m, _ in list(marks.values())[len(kept):])
        pending.clear()
        return out

    for a in actions:
        if a.op in COLUMN_OPS:
            if a.column in pending:
                df = flush(df)
            types = field_types(df)
            if a.column in types:
                pending[a.column] = (a, COLUMN_OPS[a.op](col(a.column), types[a.column], a.params))
            continue
        df = flush(df)
        if a.op == "drop_column":
            df = df.select(*[col(c) for c in df.columns if c != a.column])
        elif a.op == "rename":
            names = a.params["names"]
            df = df.toDF(*[names.get(c, c) for c in df.columns])
        elif a.op == "drop_duplicates":
            df = drop_duplicates(df)
        elif a.op == "flag_near_duplicates":
            df = flag_near_duplicates(df, config, a.params.get("columns") or ([a.column] if a.column else None))
        else:
            raise ValueError(f"unknown operation {a.op!r}")
    return flush(df)


# --- single repairs as plain functions --------------------------------------

def null_placeholders(df: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Empty strings and placeholder words become NULL in every column."""
    return apply_actions(df, [
        Action("fix_missing", "null_placeholders", c,
               {"tokens": config.placeholders, "blanks": config.blank_cells_to_null})
        for c in field_types(df)], config)


# A run of blanks, or one dash or dot.
_JOINT = re.compile(r"\s+|[-.]")


def snake_case_names(columns) -> dict[str, str]:
    """Old name -> snake_case name; later duplicates get a numeric suffix."""
    out, used = {}, set()
    for c in columns:
        base = "_".join(_JOINT.split(c.strip())).lower()
        name, i = base, 2
        while name in used:
            name, i = f"{base}_{i}", i + 1
        used.add(name)
        out[c] = name
    return out


def snake_case(df: DataFrame) -> DataFrame:
    names = snake_case_names(field_types(df))
    return df.toDF(*[names.get(c, c) for c in df.columns])


def normalise_money(df: DataFrame, config: Config = DEFAULT, columns=None) -> DataFrame:
    """Salary-like columns to plain numbers; what does not parse becomes NULL."""
    from ..config import MONEY_WORDS

    columns = columns or [c for c in field_types(df) if config.has_role(c, MONEY_WORDS)]
    return apply_actions(df, [Action("fix_formats", "to_number", c) for c in columns], config)


def parse_dates(df: DataFrame, config: Config = DEFAULT, columns=None) -> DataFrame:
    """Date and birth columns to timestamps; what does not parse becomes NULL."""
    columns = columns or [c for c in field_types(df) if config.has_role(c, ("date", "birth"))]
    return apply_actions(df, [Action("fix_formats", "to_date", c, {"as_text": False}) for c in columns], config)


def nullify_ages(df: DataFrame, config: Config = DEFAULT, columns=None) -> DataFrame:
    """Age columns of any type to numbers within range, everything else NULL."""
    types = field_types(df)
    columns = columns or [c for c in types if config.has_role(c, ("age",))]
    fixed = {}
    for c in columns:
        number = as_number(c, types[c])
        fixed[c] = F.when(number.between(*config.age_repair_range), number)
    return df.withColumns(fixed)
