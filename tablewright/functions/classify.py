"""Labels for the shape of a text value."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .parse import parse_date
from .text import strip

# Label and pattern, tried in this order; date patterns match a
# prefix, number patterns the whole value.  One to three digits count as
# comma_formatted because the group part may be absent.
DATE_SHAPES = (
    ("YYYY-MM-DD", r"^\d{4}-\d{2}-\d{2}"),
    ("MM/DD/YYYY", r"^\d{1,2}/\d{1,2}/\d{4}"),
    ("MM-DD-YYYY", r"^\d{1,2}-\d{1,2}-\d{4}"),
    ("DD Month YYYY", r"^\d{1,2} [\p{L}\p{N}_]+ \d{4}"),
)
NUMBER_SHAPES = (
    ("comma_formatted", r"^\$?\d{1,3}(,\d{3})*(\.\d+)?$"),
    ("currency_symbol", r"^\$\d+(\.\d+)?$"),
    ("plain_integer", r"^\d+$"),
    ("decimal", r"^\d+\.\d+$"),
)
LEXICAL_CLASSES = ("integer", "decimal", "boolean", "date", "string")


def _first_match(c: Column, shapes) -> Column:
    label = F.when(c.rlike(shapes[0][1]), F.lit(shapes[0][0]))
    for name, pattern in shapes[1:]:
        label = label.when(c.rlike(pattern), F.lit(name))
    return label


def date_shape(c: Column) -> Column:
    return _first_match(c, DATE_SHAPES)


def number_shape(c: Column) -> Column:
    return _first_match(c, NUMBER_SHAPES)


def date_separator(c: Column) -> Column:
    """Two-way split of parseable dates: slash or dash."""
    return (F.when(parse_date(c).isNull(), F.lit(None).cast("string"))
            .when(c.contains("/"), F.lit("MM/DD/YYYY or DD/MM/YYYY"))
            .when(c.contains("-"), F.lit("YYYY-MM-DD or MM-DD-YYYY")))


def lexical_class(c: Column) -> Column:
    """What kind of value the text spells."""
    s = strip(c)
    return (F.when(c.isNull(), F.lit(None).cast("string"))
            .when(s.rlike(r"^[+-]?\d+$"), F.lit("integer"))
            .when(s.rlike(r"^[+-]?(\d+\.\d*|\.\d+|\d+(\.\d*)?[eE][+-]?\d+)$"), F.lit("decimal"))
            .when(F.lower(s).isin("true", "false"), F.lit("boolean"))
            .when(parse_date(c).isNotNull(), F.lit("date"))
            .otherwise(F.lit("string")))
