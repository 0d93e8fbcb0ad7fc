"""Fit each repair step: a few aggregates decide, actions carry the result.

Each ``fit_*`` function reads its input with one or two bounded aggregates and
returns actions; nothing is changed until they are applied.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from ..config import (AGE_WORDS, DATE_CHECK_WORDS, DATE_WORDS, DEFAULT, EMAIL_WORDS,
                      KEY_WORDS, LOWER_WORDS, NON_NUMERIC_WORDS, PHONE_REPAIR_WORDS,
                      SKIP_OUTLIER_WORDS, TITLE_WORDS, Config)
from ..functions import is_null, parse_date, strip_to_number
from ..operators.constants import top_shares
from ..operators.profile import numeric_values
from ..operators.quantiles import order_statistics, quantiles
from ..operators.repairs import Action, apply_actions, snake_case_names
from ..operators.rows import (aggregate_row, col, field_types, is_numeric,
                              is_temporal, value_counts)


def imputation_strategy(share: float, config: Config) -> str:
    """Mean for moderate gaps, median for small and for large ones."""
    if share < config.median_below_share or share >= config.median_from_share:
        return "median"
    return "mean"


def fit_nulls(df: DataFrame, config: Config = DEFAULT) -> list[Action]:
    return [Action("fix_missing", "null_placeholders", c,
                   {"tokens": list(config.placeholders), "blanks": config.blank_cells_to_null})
            for c, t in field_types(df).items()
            if isinstance(t, (T.StringType, T.DateType, T.DoubleType, T.FloatType))]


def modes(df: DataFrame, columns) -> dict[str, str]:
    """Most frequent non-null value per column, the smallest of ties."""
    if not columns:
        return {}
    best = F.min_by("value", F.struct(-F.col("n"), F.col("value")))
    rows = (value_counts(df, columns).filter(F.col("value").isNotNull())
            .groupBy("column_name").agg(best.alias("mode")).collect())
    return {r["column_name"]: r["mode"] for r in rows}


def fit_impute(df: DataFrame, config: Config = DEFAULT) -> list[Action]:
    """Drop sparse columns, choose the filler of the others.

    Expects placeholders already nulled.  Statistics are taken only for
    columns that have gaps.
    """
    types = field_types(df)
    values = numeric_values(df)
    aggregates = [F.count(F.lit(1)).alias("n")]
    for i, (c, t) in enumerate(types.items()):
        aggregates.append(F.count_if(is_null(col(c), t)).alias(f"z{i}"))
        if c in values:
            aggregates.append(F.avg(values[c]).alias(f"m{i}"))
    row = aggregate_row(df, aggregates)
    n = row["n"]
    actions, medians, dates, texts, shares = [], [], [], [], {}
    fill: dict[str, tuple] = {}
    for i, (c, t) in enumerate(types.items()):
        if not n or row[f"z{i}"] == 0 or c == config.near_duplicate_column:
            continue
        share = shares[c] = row[f"z{i}"] / n
        if share > config.missing_drop_share:
            actions.append(Action("fix_missing", "drop_column", c, {"missing_share": share}))
        elif is_numeric(t):
            if imputation_strategy(share, config) == "mean":
                fill[c] = ("mean", row[f"m{i}"])
            else:
                medians.append(c)
        elif not config.impute_key_columns and config.has_role(c, KEY_WORDS):
            continue
        elif is_temporal(t):
            dates.append(c)
        elif isinstance(t, (T.StringType, T.BooleanType)):
            texts.append(c)
    counts = {c: n - row[f"z{i}"] for i, c in enumerate(types)}
    if medians:
        found = quantiles(df, {c: values[c] for c in medians}, [0.5], counts, config.exact_quantile_rows)
        fill.update({c: ("median", found[c][0]) for c in medians})
    if dates:
        micros = {c: F.unix_micros(col(c).cast("timestamp")) for c in dates}
        found = order_statistics(df, micros, {c: [counts[c] // 2] for c in dates}, counts)
        fill.update({c: ("median_date", found[c, counts[c] // 2]) for c in dates})
    common = modes(df, texts)
    fill.update({c: ("mode", common.get(c, "UNKNOWN")) for c in texts})
    for c in types:
        if c in fill:
            how, value = fill[c]
            kind = {"mean": "number", "median": "number", "median_date": "micros", "mode": "text"}[how]
            actions.append(Action("fix_missing", "fill", c,
                                  {"kind": kind, "value": value, "how": how, "missing_share": shares[c]}))
    return actions


def fit_missing(df: DataFrame, config: Config = DEFAULT) -> list[Action]:
    nulls = fit_nulls(df, config)
    return nulls + fit_impute(apply_actions(df, nulls, config), config)


def fit_encoding(df: DataFrame, config: Config = DEFAULT) -> list[Action]:
    op = "fold_ascii" if config.fold_ascii else "strip"
    return [Action("fix_formats", op, c) for c, t in field_types(df).items() if isinstance(t, T.StringType)]


def fit_formats(df: DataFrame, config: Config = DEFAULT) -> list[Action]:
    """Trim text, then choose per column between date, number and text.

    One scan measures how many values of each text column parse either way.
    """
    encoding = fit_encoding(df, config)
    folded = apply_actions(df, encoding, config)
    types = field_types(folded)
    texts = [c for c, t in types.items() if isinstance(t, T.StringType)]
    aggregates = []
    for i, c in enumerate(texts):
        aggregates.append(F.count(col(c)).alias(f"n{i}"))
        if config.has_role(c, DATE_WORDS):
            aggregates.append(F.count(parse_date(col(c))).alias(f"d{i}"))
        if not config.has_role(c, NON_NUMERIC_WORDS):
            aggregates.append(F.count(strip_to_number(col(c))).alias(f"v{i}"))
    row = aggregate_row(folded, aggregates) if aggregates else {}
    actions = list(encoding)
    as_text = config.iso_dates_as_text
    for i, c in enumerate(texts):
        n = max(row[f"n{i}"], 1)
        dates, numbers = row.get(f"d{i}"), row.get(f"v{i}")
        if dates is not None and dates / n > config.date_parse_share:
            actions.append(_date_action(c, dates, row[f"n{i}"], as_text))
        elif numbers is not None and numbers / n >= config.numeric_parse_share:
            actions.append(Action("fix_formats", "to_number", c, {"parsed": numbers, "nulled": row[f"n{i}"] - numbers}))
        elif dates is not None and dates / n > config.date_reparse_share:
            actions.append(_date_action(c, dates, row[f"n{i}"], as_text))
    if as_text:
        actions += [Action("fix_formats", "to_date", c, {"as_text": True}) for c, t in types.items() if is_temporal(t)]
    return actions


def _date_action(c: str, parsed: int, present: int, as_text: bool) -> Action:
    return Action("fix_formats", "to_date", c, {"as_text": as_text, "parsed": parsed, "nulled": present - parsed})


def fit_domains(df: DataFrame, config: Config = DEFAULT) -> list[Action]:
    """Nullify values outside the domain the column name implies; no scan."""
    actions = []

    def add(op, c, params=None):
        actions.append(Action("fix_broken_entries", op, c, params or {}))

    for c, t in field_types(df).items():
        if c == config.near_duplicate_column:
            continue
        if config.has_role(c, AGE_WORDS) and is_numeric(t):
            add("null_age", c, {"range": list(config.age_repair_range)})
        if config.has_role(c, EMAIL_WORDS):
            add("null_email", c)
        if config.has_role(c, PHONE_REPAIR_WORDS):
            add("null_phone", c)
        if config.nullify_bad_dates and config.has_role(c, DATE_CHECK_WORDS) and isinstance(t, T.StringType):
            add("null_bad_date", c)
        for r in config.rules_for(c):
            if r.repair is not None:
                add("rule", c, {"rule": r.name, "condition": r.condition, "repair": r.repair, "column": c})
    return actions


def fit_caps(df: DataFrame, config: Config = DEFAULT, log: dict | None = None) -> list[Action]:
    """Fences for numeric columns that have values beyond them."""
    columns = [c for c, t in field_types(df).items()
               if is_numeric(t) and not config.has_role(c, SKIP_OUTLIER_WORDS)]
    values = numeric_values(df, columns)
    if not values:
        return []
    aggregates = []
    for i, c in enumerate(columns):
        aggregates += [F.count(values[c]).alias(f"n{i}"), F.min(values[c]).alias(f"lo{i}"),
                       F.max(values[c]).alias(f"hi{i}")]
    row = aggregate_row(df, aggregates)
    counts = {c: row[f"n{i}"] for i, c in enumerate(columns)}
    # A column whose smallest and largest value agree has no spread to cap.
    spread = [c for i, c in enumerate(columns) if counts[c] and row[f"lo{i}"] != row[f"hi{i}"]]
    quartiles = quantiles(df, {c: values[c] for c in spread}, [0.25, 0.75], counts, config.exact_quantile_rows)
    fences = {}
    for c in spread:
        q1, q3 = quartiles[c]
        reach = config.iqr_multiplier * (q3 - q1)
        i = columns.index(c)
        if q3 != q1 and (row[f"lo{i}"] < q1 - reach or row[f"hi{i}"] > q3 + reach):
            fences[c] = (q1 - reach, q3 + reach)
    if not fences:
        return []
    beyond = aggregate_row(df, [
        F.count_if((values[c] < F.lit(lo)) | (values[c] > F.lit(hi))).alias(c) for c, (lo, hi) in fences.items()])
    if log is not None:
        log.update({c: {"capped": beyond[c], "lower": round(lo, 4), "upper": round(hi, 4)}
                    for c, (lo, hi) in fences.items()})
    return [Action("fix_broken_entries", "cap", c, {"lower": lo, "upper": hi, "capped": beyond[c]})
            for c, (lo, hi) in fences.items()]


def fit_broken(df: DataFrame, config: Config = DEFAULT, log: dict | None = None) -> list[Action]:
    domains = fit_domains(df, config)
    return domains + fit_caps(apply_actions(df, domains, config), config, log)


def fit_text_case(df: DataFrame, config: Config = DEFAULT) -> list[Action]:
    """Title case for names and categories, lower case for addresses and logins."""
    actions = []
    for c, t in field_types(df).items():
        if not isinstance(t, T.StringType):
            continue
        op = ("title" if config.has_role(c, TITLE_WORDS)
              else "lower" if config.has_role(c, LOWER_WORDS) else None)
        if op:
            actions.append(Action("fix_text_consistency", op, c))
    return actions


def fit_duplicates(df: DataFrame, config: Config = DEFAULT) -> list[Action]:
    from ..operators.similarity import name_columns

    actions = [Action("fix_duplicates", "drop_duplicates")]
    names = name_columns(df, config)
    if names:
        actions.append(Action("fix_duplicates", "flag_near_duplicates", None,
                              {"columns": names, "threshold": config.similarity_threshold, "window": config.near_duplicate_window}))
    return actions


def fit_names(df: DataFrame, config: Config = DEFAULT) -> list[Action]:
    """snake_case names, near-constant columns out, integral doubles to integers."""
    names = snake_case_names(field_types(df))
    renamed = df.toDF(*[names.get(c, c) for c in df.columns])
    actions = [Action("fix_column_names", "rename", None, {"names": names})]
    types = field_types(renamed)
    # The near-duplicate flag is a marker, not data.
    candidates = [c for c in types if c != config.near_duplicate_column]
    shares = top_shares(renamed, config, candidates)
    for c, share in shares.items():
        actions.append(Action("fix_column_names", "drop_column", c, {"constant_share": share}))
    actions += fit_integral(renamed, config, [c for c in candidates if c not in shares])
    return actions


def fit_integral(df: DataFrame, config: Config = DEFAULT, columns=None) -> list[Action]:
    """Numeric columns that hold whole numbers only become nullable integers."""
    types = field_types(df)
    columns = [c for c in (columns or types) if is_numeric(types[c]) and not isinstance(types[c], T.LongType)]
    if not columns:
        return []
    values = numeric_values(df, columns)
    aggregates = []
    for i, c in enumerate(columns):
        whole = (values[c] == F.floor(values[c])) & (F.abs(values[c]) < 2.0 ** 63)
        aggregates += [F.count(values[c]).alias(f"n{i}"), F.coalesce(F.bool_and(whole), F.lit(False)).alias(f"w{i}")]
    row = aggregate_row(df, aggregates)
    return [Action("fix_column_names", "to_long", c)
            for i, c in enumerate(columns) if row[f"n{i}"] and row[f"w{i}"]]
