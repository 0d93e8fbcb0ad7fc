"""Detection of values that cannot be right for the column's role."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import (AGE_WORDS, BIRTH_WORDS, DATE_CHECK_WORDS, DEFAULT, EMAIL_PATTERN,
                      EMAIL_WORDS, PHONE_CHECK_WORDS, PHONE_PATTERN, Config)
from ..functions import as_text, is_null, parse_date, parse_number
from .rows import ROW_ID, col, expression, field_types, is_numeric, is_temporal, tall_aggregates


def as_number(name: str, dtype) -> Column:
    return col(name).cast("double") if is_numeric(dtype) else parse_number(as_text(col(name), dtype))


def as_timestamp(name: str, dtype) -> Column:
    if is_temporal(dtype):
        return col(name).cast("timestamp_ntz")
    return parse_date(as_text(col(name), dtype))


def out_of_range(number: Column, bounds: tuple[float, float]) -> Column:
    return (number < bounds[0]) | (number > bounds[1])


def broken_rules(df: DataFrame, config: Config = DEFAULT, as_of=None) -> list[tuple[str, str, Column]]:
    """(column, rule, predicate) for every check the column names call for.

    Predicates are false, never NULL, for missing cells.
    """
    now = F.lit(as_of).cast("timestamp_ntz") if as_of is not None else F.current_timestamp().cast("timestamp_ntz")
    rules = []
    for name, dtype in field_types(df).items():
        text = as_text(col(name), dtype)
        present = ~is_null(col(name), dtype)
        found = []
        if config.has_role(name, AGE_WORDS) and not is_temporal(dtype):
            number = as_number(name, dtype)
            found.append(("invalid_ages", out_of_range(number, config.age_report_range)
                          & ~F.isnan(number)))
        if config.has_role(name, EMAIL_WORDS):
            found.append(("invalid_emails", present & ~text.rlike(EMAIL_PATTERN)))
        if config.has_role(name, PHONE_CHECK_WORDS):
            found.append(("invalid_phones", present & ~text.rlike(PHONE_PATTERN)))
        if config.has_role(name, DATE_CHECK_WORDS):
            # A plain number read as a date is an epoch offset, hence valid.
            ts = as_timestamp(name, dtype)
            if not is_numeric(dtype):
                found.append(("unparseable_dates", present & ts.isNull()))
                if config.has_role(name, BIRTH_WORDS):
                    found.append(("future_birth_dates", ts > now))
        found += [(r.name, present & expression(r.condition, name)) for r in config.rules_for(name)]
        rules += [(name, rule, F.coalesce(p, F.lit(False))) for rule, p in found]
    return rules


def broken_counts(df: DataFrame, config: Config = DEFAULT, as_of=None) -> DataFrame:
    """Offending rows per (column, rule), rules that fire only; one scan."""
    rows = [((c, r), {"n": F.count_if(p)}) for c, r, p in broken_rules(df, config, as_of)]
    return tall_aggregates(df, rows, [("column_name", "string"), ("rule", "string")],
                           [("n", "bigint")]).filter("n > 0")


def violations(df: DataFrame, config: Config = DEFAULT, as_of=None, rules=None) -> DataFrame:
    """(column_name, rule, _row_id, value) for every offending cell; no shuffle."""
    types = field_types(df)
    found = broken_rules(df, config, as_of)
    if rules is not None:
        found = [f for f in found if f[1] in rules]
    if not found:
        return df.sparkSession.createDataFrame(
            [], f"column_name string, rule string, {ROW_ID} bigint, value string")
    cells = F.array(*[
        F.when(p, F.struct(F.lit(c).alias("column_name"), F.lit(r).alias("rule"),
                           as_text(col(c), types[c]).alias("value"))) for c, r, p in found])
    return (df.select(ROW_ID, F.explode(F.filter(cells, lambda x: x.isNotNull())).alias("v"))
            .select("v.column_name", "v.rule", ROW_ID, "v.value"))


def broken_examples(df: DataFrame, k: int = 5, config: Config = DEFAULT, as_of=None) -> DataFrame:
    """First k offending values per (column, rule) in row order."""
    w = Window.partitionBy("column_name", "rule").orderBy(ROW_ID)
    return (violations(df, config, as_of).withColumn("rank", F.row_number().over(w))
            .filter(F.col("rank") <= k).select("column_name", "rule", "rank", ROW_ID, "value"))
