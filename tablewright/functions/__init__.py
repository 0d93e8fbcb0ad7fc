"""Column expressions shared by all operators."""

from .classify import date_separator, date_shape, lexical_class, number_shape
from .missing import is_blank, is_missing, is_null, is_placeholder, null_out
from .parse import iso_day, parse_date, parse_number, strip_to_number
from .text import as_text, ascii_fold, strip, title_case, token_sort_key

__all__ = [
    "as_text", "ascii_fold", "date_separator", "date_shape", "is_blank",
    "is_missing", "is_null", "is_placeholder", "iso_day", "lexical_class",
    "null_out", "number_shape", "parse_date", "parse_number", "strip",
    "strip_to_number", "title_case", "token_sort_key",
]
