"""Detection of mixed formats within a column."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..config import DATE_WORDS, DEFAULT, Config
from ..functions import as_text, date_separator, date_shape, lexical_class, number_shape
from ..functions.classify import DATE_SHAPES, LEXICAL_CLASSES, NUMBER_SHAPES
from .rows import col, field_types, string_columns, tall_aggregates

CHECKS = ("mixed_types", "multiple_date_formats", "multiple_numeric_formats")
SEPARATORS = ("MM/DD/YYYY or DD/MM/YYYY", "YYYY-MM-DD or MM-DD-YYYY")


def date_columns(df: DataFrame, config: Config) -> list[str]:
    return [c for c in field_types(df) if config.has_role(c, DATE_WORDS)]


def labelled_columns(df: DataFrame, config: Config, checks) -> list:
    """(column, check, label expression, possible labels) for each check."""
    types = field_types(df)
    out = []
    for c in types:
        text = as_text(col(c), types[c])
        if "mixed_types" in checks and c in string_columns(df):
            out.append((c, "mixed_types", lexical_class(text), LEXICAL_CLASSES))
        if "multiple_date_formats" in checks and config.has_role(c, DATE_WORDS):
            out.append((c, "multiple_date_formats", date_shape(text), [n for n, _ in DATE_SHAPES]))
        if "date_separators" in checks and config.has_role(c, DATE_WORDS):
            out.append((c, "date_separators", date_separator(text), SEPARATORS))
        if "multiple_numeric_formats" in checks and c in string_columns(df):
            out.append((c, "multiple_numeric_formats", number_shape(text),
                        [n for n, _ in NUMBER_SHAPES]))
    return out


def format_counts(df: DataFrame, config: Config = DEFAULT, checks=CHECKS,
                  sample_fraction: float | None = None, seed: int = 42) -> DataFrame:
    """Rows per (column, check, label), labels that occur only.

    Every label is its own conditional count, so all columns and checks share
    one scan and nothing is grouped.
    """
    if sample_fraction is not None:
        df = df.sample(fraction=sample_fraction, seed=seed)
    # The label is computed once per row and column, then counted.
    labelled = labelled_columns(df, config, checks)
    narrowed = df.select(*[expr.alias(f"l{i}") for i, (_, _, expr, _) in enumerate(labelled)])
    rows = [((c, check, label), {"n": F.count_if(F.col(f"l{i}") == label)})
            for i, (c, check, _, labels) in enumerate(labelled) for label in labels]
    return tall_aggregates(narrowed, rows,
                           [("column_name", "string"), ("check_name", "string"), ("label", "string")],
                           [("n", "bigint")]).filter("n > 0")


def format_issues(df: DataFrame, config: Config = DEFAULT, checks=CHECKS,
                  sample_fraction: float | None = None) -> DataFrame:
    """Columns with more than one label: ``<column>_<check>`` and the labels.

    Grouping happens on the counts: at most a few rows per column.
    """
    return (format_counts(df, config, checks, sample_fraction)
            .groupBy("column_name", "check_name")
            .agg(F.count(F.lit(1)).alias("n_labels"),
                 F.array_join(F.array_sort(F.collect_set("label")), ", ").alias("labels"))
            .filter("n_labels > 1")
            .withColumn("issue", F.concat_ws("_", "column_name", "check_name")))


#: Kinds of JSON value by the type that Spark gives a variant.
_KINDS = {"BIGINT": "number", "DOUBLE": "number", "FLOAT": "number", "STRING": "text", "BOOLEAN": "boolean", "VOID": "null"}


def json_types(df: DataFrame, columns=None) -> DataFrame:
    """(column_name, key, kind, n): what kinds of value each key of JSON text holds.

    Kinds are number, text, boolean, object, array and null.  Texts are parsed
    once, as variants; what isn't a JSON object counts nothing.  A key with
    several kinds beside null is a column of mixed types.
    """
    out = None
    for c in (columns or string_columns(df)):
        rows = df.select(F.try_parse_json(col(c)).alias("_json")).where(F.schema_of_variant("_json").startswith("OBJECT"))
        cells = rows.lateralJoin(df.sparkSession.tvf.variant_explode(F.col("_json").outer()))
        name = F.regexp_extract(F.schema_of_variant("value"), "^[A-Z]+", 0)
        pairs = [x for item in _KINDS.items() for x in map(F.lit, item)]
        kind = F.coalesce(F.try_element_at(F.create_map(*pairs), name), F.when(name == "DECIMAL", F.lit("number")), F.lower(name))
        part = cells.groupBy(F.lit(c).alias("column_name"), "key", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))
        out = part if out is None else out.unionByName(part)
    return out
