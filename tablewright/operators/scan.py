"""Everything the workflow needs to know per column, from a single scan."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from ..config import DEFAULT, Config
from ..functions import is_blank, is_missing, is_null, is_placeholder
from .broken import broken_rules
from .formats import CHECKS, labelled_columns
from .profile import numeric_values, text_bytes
from .rows import aggregate_row, col, field_types


@dataclass
class TableScan:
    """Counts per column; the size depends on the number of columns only."""

    n_rows: int = 0
    text_bytes: int = 0
    types: dict = field(default_factory=dict)
    missing: dict[str, dict] = field(default_factory=dict)
    formats: dict[tuple[str, str], dict[str, int]] = field(default_factory=dict)
    broken: dict[tuple[str, str], int] = field(default_factory=dict)
    numeric: dict[str, dict] = field(default_factory=dict)

    @property
    def null_cells(self) -> int:
        return sum(m["n_null"] for m in self.missing.values())

    def info(self) -> dict:
        return {"shape": (self.n_rows, len(self.types)),
                "dtypes": {c: t.simpleString() for c, t in self.types.items()},
                "text_bytes": self.text_bytes,
                "non_null": {c: self.n_rows - m["n_null"] for c, m in self.missing.items()}}


def scan_table(df: DataFrame, config: Config = DEFAULT, as_of=None, formats: bool = True) -> TableScan:
    """Missing, format, broken and numeric summaries side by side.

    The detectors in their own modules give the same numbers one at a time;
    this shares one read of the table between all of them.
    """
    types = field_types(df)
    labels = labelled_columns(df, config, CHECKS) if formats else []
    rules = broken_rules(df, config, as_of)
    # Labels are computed once per row and counted below.
    wide = df.select("*", *[e.alias(f"_l{i}") for i, (_, _, e, _) in enumerate(labels)])
    aggregates = [F.count(F.lit(1)).alias("n"), F.coalesce(text_bytes(df), F.lit(0)).alias("bytes")]
    for i, (c, t) in enumerate(types.items()):
        v = col(c)
        aggregates += [F.count_if(is_null(v, t)).alias(f"z{i}"),
                       F.count_if(is_blank(v, t)).alias(f"b{i}"),
                       F.count_if(is_placeholder(v, t, config.placeholders)).alias(f"p{i}"),
                       F.count_if(is_missing(v, t, config.placeholders)).alias(f"x{i}")]
    for i, (_, _, _, names) in enumerate(labels):
        aggregates += [F.count_if(F.col(f"_l{i}") == n).alias(f"l{i}_{k}") for k, n in enumerate(names)]
    aggregates += [F.count_if(p).alias(f"r{i}") for i, (_, _, p) in enumerate(rules)]
    values = numeric_values(df)
    for i, v in enumerate(values.values()):
        aggregates += [F.count(v).alias(f"vn{i}"), F.avg(v).alias(f"vm{i}"), F.stddev_pop(v).alias(f"vs{i}")]
    row = aggregate_row(wide, aggregates)

    out = TableScan(row["n"], row["bytes"], types)
    for i, c in enumerate(types):
        n = row[f"x{i}"]
        out.missing[c] = {"n_null": row[f"z{i}"], "n_blank": row[f"b{i}"], "n_placeholder": row[f"p{i}"],
                          "n_missing": n, "pct_missing": round(100.0 * n / row["n"], 2) if row["n"] else 0.0}
    for i, (c, check, _, names) in enumerate(labels):
        found = {n: row[f"l{i}_{k}"] for k, n in enumerate(names) if row[f"l{i}_{k}"]}
        if found:
            out.formats[c, check] = found
    out.broken = {(c, r): row[f"r{i}"] for i, (c, r, _) in enumerate(rules) if row[f"r{i}"]}
    out.numeric = {c: {"n": row[f"vn{i}"], "mean": row[f"vm{i}"], "std": row[f"vs{i}"]}
                   for i, c in enumerate(values)}
    return out
