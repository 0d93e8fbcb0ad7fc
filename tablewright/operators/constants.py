"""Columns dominated by one value, found without grouping by value."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from ..config import DEFAULT, Config
from ..functions import as_text, is_null
from .rows import aggregate_row, col, field_types


def top_shares(df: DataFrame, config: Config = DEFAULT, columns=None) -> dict[str, float]:
    """Share of the dominating value for columns where one reaches the threshold.

    NULL counts as a value.  A value with more than half of the rows also owns
    the middle of the rows ordered by hash, so a small quantile sketch of the
    hash names the only possible candidate; a second scan counts it exactly.
    No column is shuffled, however many distinct values it has.
    """
    if not 0.6 <= config.near_constant_share <= 1.0:
        raise ValueError("near_constant_share must lie between 0.6 and 1")
    types = field_types(df)
    columns = list(types) if columns is None else list(columns)
    if not columns:
        return {}
    text, null, code = {}, {}, {}
    for c in columns:
        null[c] = is_null(col(c), types[c])
        text[c] = as_text(col(c), types[c])
        # 52 bits: quantile sketches hold doubles.
        code[c] = F.shiftrightunsigned(F.xxhash64(null[c], text[c]), 12)
    first = aggregate_row(df, [F.count(F.lit(1)).alias("n")] + [
        F.approx_percentile(code[c], 0.5, 200).alias(f"h{i}") for i, c in enumerate(columns)])
    n = first["n"]
    if n < config.near_constant_min_rows:
        return {}
    aggregates = []
    for i, c in enumerate(columns):
        hit = code[c] == F.lit(first[f"h{i}"])
        aggregates += [F.count_if(hit).alias(f"n{i}"),
                       F.min(F.when(hit, text[c])).alias(f"lo{i}"),
                       F.max(F.when(hit, text[c])).alias(f"hi{i}"),
                       F.count_if(hit & null[c]).alias(f"z{i}")]
    second = aggregate_row(df, aggregates)
    need = config.near_constant_share * n
    out, unsure = {}, []
    for i, c in enumerate(columns):
        if second[f"n{i}"] < need:
            continue
        mixed = second[f"lo{i}"] != second[f"hi{i}"] or 0 < second[f"z{i}"] < second[f"n{i}"]
        (unsure.append(c) if mixed else out.__setitem__(c, second[f"n{i}"] / n))
    for c in unsure:
        # Two values share a hash: count the values themselves.
        best = (df.select(null[c].alias("z"), text[c].alias("v")).groupBy("z", "v").count()
                .agg(F.max("count")).first()[0])
        if best >= math.ceil(need):
            out[c] = best / n
    return {c: out[c] for c in columns if c in out}
