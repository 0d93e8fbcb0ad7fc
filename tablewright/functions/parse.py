"""Text to number and text to date, without exceptions under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import strip

# Month names accepted in "3 Feb 2021" / "3 February 2021".
MONTHS = ("january", "february", "march", "april", "may", "june", "july",
          "august", "september", "october", "november", "december")

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"

ISO_DATE = r"^\d{4}-\d{1,2}-\d{1,2}([ T]\d{1,2}:\d{2}(:\d{2}(\.\d{1,9})?)?)?$"
ISO_ZONED = r"^\d{4}-\d{1,2}-\d{1,2}[ T]\d{1,2}:\d{2}(:\d{2}(\.\d{1,9})?)? ?(Z|UTC|[+-]\d{2}:?\d{2})$"
YEAR_SLASH = r"^(\d{4})/(\d{1,2})/(\d{1,2})$"
US_SLASH = r"^(\d{1,2})/(\d{1,2})/(\d{4})$"
US_DASH = r"^(\d{1,2})-(\d{1,2})-(\d{4})$"
DAY_MONTH = r"^(\d{1,2}) ([A-Za-z]{3,9}) (\d{4})$"
MONTH_DAY = r"^([A-Za-z]{3,9}) (\d{1,2}), ?(\d{4})$"
# What every layout begins with.
DATE_START = r"^(?:\d{1,4}[-/ ]|[A-Za-z]{3,9} \d)"


def parse_number(c: Column) -> Column:
    """Double value of numeric text, NULL otherwise.

    The pattern guards the cast: Spark alone would read ``5d`` or ``NaN``.
    """
    s = strip(c)
    return F.when(s.rlike(NUMBER), s.try_cast("double"))


def strip_to_number(c: Column) -> Column:
    """Double value after removing everything but digits, dot and minus."""
    return parse_number(F.regexp_replace(c, r"[^\d.\-]+", ""))


def parse_date(c: Column) -> Column:
    """Timestamp (no zone) of text in one of the accepted layouts, else NULL.

    Layouts, month first where ambiguous: ``yyyy-MM-dd`` with optional time,
    ``yyyy/MM/dd``, ``M/d/yyyy``, ``M-d-yyyy``, ``d MMM yyyy``, ``MMM d,
    yyyy`` and both with full month names.  A time with a zone or offset
    counts in UTC.  Each layout is rewritten to ISO text so one
    exception-free cast does the parsing.
    """
    s = strip(c)
    pairs = []
    for i, m in enumerate(MONTHS, start=1):
        for key in dict.fromkeys((m[:3], m)):
            pairs += [F.lit(key), F.lit(f"{i:02d}")]
    named = lambda pattern, at: F.try_element_at(F.create_map(*pairs), F.lower(F.regexp_extract(s, pattern, at)))
    iso = (F.when(s.rlike(ISO_DATE), s)
           .when(s.rlike(US_SLASH), F.regexp_replace(s, US_SLASH, "$3-$1-$2"))
           .when(s.rlike(US_DASH), F.regexp_replace(s, US_DASH, "$3-$1-$2"))
           .when(s.rlike(DAY_MONTH), F.concat(F.regexp_extract(s, DAY_MONTH, 3), F.lit("-"),
                                              named(DAY_MONTH, 2), F.lit("-"),
                                              F.regexp_extract(s, DAY_MONTH, 1)))
           .when(s.rlike(YEAR_SLASH), F.regexp_replace(s, YEAR_SLASH, "$1-$2-$3"))
           .when(s.rlike(MONTH_DAY), F.concat(F.regexp_extract(s, MONTH_DAY, 3), F.lit("-"),
                                              named(MONTH_DAY, 1), F.lit("-"),
                                              F.regexp_extract(s, MONTH_DAY, 2))))
    # As a point in time, then as the clock in UTC whatever the session's zone.
    timed = F.regexp_replace(s, r"^([^ T]+[ T]\d{1,2}:\d{2})(?= ?[ZU+-])", "$1:00")
    point = F.regexp_replace(timed, r" ?([+-]\d{2}):?(\d{2})$", "$1:$2").try_cast("timestamp")
    zoned = F.convert_timezone(F.current_timezone(), F.lit("UTC"), point.cast("timestamp_ntz"))
    # The first characters tell whether a layout is worth trying; a zone only where no plain layout fits.
    return F.when(s.rlike(DATE_START), F.coalesce(iso.try_cast("timestamp_ntz"), F.when(s.rlike(ISO_ZONED), zoned)))


def iso_day(ts: Column) -> Column:
    """``yyyy-MM-dd`` text of a date or timestamp."""
    return ts.cast("date").cast("string")
