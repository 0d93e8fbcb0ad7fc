import random

import pytest
from pyspark.sql import functions as F

from tablewright import functions as fn
from tablewright.config import PLACEHOLDERS, Config
from tablewright.functions.lcs import lcs_lengths
from tablewright.functions.text import WHITESPACE


def apply(spark, values, expr, schema="s string"):
    df = spark.createDataFrame([(v,) for v in values], schema).coalesce(1)
    return [r[0] for r in df.select(expr(F.col("s"))).collect()]


def test_strip_matches_python(spark):
    values = [None, "", " \t a b　\xa0", "\x1c x \x85", "plain", " ", "\v\f"]
    assert apply(spark, values, fn.strip) == [v.strip() if v is not None else None for v in values]
    assert all(ch.isspace() for ch in WHITESPACE)


def test_title_case_matches_python(spark):
    values = ["o'brien 3rd co-op", "ÉLAN vital", "a1b2", "", None, "  x", "MARY-ANN"]
    assert apply(spark, values, fn.title_case) == [v.title() if v is not None else None for v in values]


def test_ascii_fold(spark):
    assert apply(spark, [" café ", "日本", None], fn.ascii_fold) == ["caf", "", None]


def test_parse_number(spark):
    values = ["5", " 5.5 ", "5d", "NaN", "1e3", ".5", "-2.", "1,000", "", None, "--1"]
    assert apply(spark, values, fn.parse_number) == [5.0, 5.5, None, None, 1000.0, .5, -2.0, None, None, None, None]


def test_strip_to_number(spark):
    assert apply(spark, ["$1,234.50", "Brand#13", "1.2.3", "n/a", None], fn.strip_to_number) == [
        1234.5, 13.0, None, None, None]


def test_parse_date(spark):
    values = ["2020-02-29", "2021-02-29", "02/03/2020", "2/3/2020", "15/04/1985", "1-2-1999",
              "3 Feb 2021", "3 february 2021", "3 Foo 2021", "2020-01-02 10:11:12", "text", None]
    got = [None if v is None else str(v) for v in apply(spark, values, fn.parse_date)]
    assert got == ["2020-02-29 00:00:00", None, "2020-02-03 00:00:00", "2020-02-03 00:00:00", None,
                   "1999-01-02 00:00:00", "2021-02-03 00:00:00", "2021-02-03 00:00:00", None,
                   "2020-01-02 10:11:12", None, None]


def test_shapes(spark):
    assert apply(spark, ["12", "1234", "$1,000.50", "$12345", "1234.5", "x"], fn.number_shape) == [
        "comma_formatted", "plain_integer", "comma_formatted", "currency_symbol", "decimal", None]
    assert apply(spark, ["2020-01-01T", "1/2/2020", "1-2-2020", "3 mars 2020", "x"], fn.date_shape) == [
        "YYYY-MM-DD", "MM/DD/YYYY", "MM-DD-YYYY", "DD Month YYYY", None]
    assert apply(spark, ["1", "1.0", "TRUE", "2020-01-01", "abc", None], fn.lexical_class) == [
        "integer", "decimal", "boolean", "date", "string", None]


def test_missing_predicates(spark):
    t = spark.createDataFrame([("x",)], "s string").schema["s"].dataType
    values = [None, "", " ", "\t", "-", "N/A ", "1900-01-01", "ok"]
    assert apply(spark, values, lambda c: fn.is_blank(c, t)) == [False, True, True, True, False, False, False, False]
    assert apply(spark, values, lambda c: fn.is_placeholder(c, t, PLACEHOLDERS)) == [
        False, False, False, False, True, True, True, False]
    assert apply(spark, values, lambda c: fn.is_missing(c, t, PLACEHOLDERS)) == [True] * 7 + [False]
    # Whitespace-only text survives unless asked for.
    assert apply(spark, values, lambda c: fn.null_out(c, t, PLACEHOLDERS)) == [
        None, None, " ", "\t", None, None, None, "ok"]
    assert apply(spark, values, lambda c: fn.null_out(c, t, PLACEHOLDERS, True)) == [None] * 7 + ["ok"]


def test_nan_is_null(spark):
    df = spark.createDataFrame([(float("nan"),), (None,), (1.0,)], "s double")
    t = df.schema["s"].dataType
    assert df.filter(fn.is_null(F.col("s"), t)).count() == 2
    assert df.select(fn.null_out(F.col("s"), t, PLACEHOLDERS).alias("x")).filter("x is null").count() == 2


def test_token_sort_key(spark):
    values = ["Smith,  John", "john SMITH", "a_b c", "José", "--", ""]
    assert apply(spark, values, fn.token_sort_key) == ["john smith", "john smith", "a_b c", "jos", "", ""]


@pytest.mark.parametrize("longest", [12, 64, 150])
def test_lcs_against_dynamic_programming(longest):
    rnd = random.Random(longest)

    def slow(a, b):
        p = [0] * (len(b) + 1)
        for x in a:
            c = [0]
            for j, y in enumerate(b):
                c.append(p[j] + 1 if x == y else max(p[j + 1], c[j]))
            p = c
        return p[-1]

    left = ["".join(rnd.choice("abcé") for _ in range(rnd.randint(0, longest))) for _ in range(120)]
    right = ["".join(rnd.choice("abcé") for _ in range(rnd.randint(0, longest))) for _ in range(120)]
    assert lcs_lengths(left, right).tolist() == [slow(a, b) for a, b in zip(left, right)]


def test_name_matching():
    cfg = Config()
    assert cfg.has_role("page_id", ("age",)) and not cfg.has_role("name", ("age",))
    tokens = cfg.with_(name_matching="token")
    assert not tokens.has_role("page_id", ("age",))
    assert tokens.has_role("createdAt", ("at",)) and tokens.has_role("cust_age", ("age",))


def test_zones_and_more_layouts(spark):
    from tablewright.functions import parse_date

    cases = {"2024-01-05T10:00:00Z": "2024-01-05 10:00:00", "2024-01-05T10:00:00+02:00": "2024-01-05 08:00:00", "2024-01-05 10:00 -0330": "2024-01-05 13:30:00",
             "2024/1/5": "2024-01-05 00:00:00", "Jan 5, 2024": "2024-01-05 00:00:00", "january 5,2024": "2024-01-05 00:00:00", "5 January 2024": "2024-01-05 00:00:00",
             "Jax 5, 2024": None, "2024-01-05T10:00:00+2": None, "2024/13/5": None, "": None, None: None}
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    assert {r.s: r.d and str(r.d) for r in df.select("s", parse_date(df.s).alias("d")).collect()} == cases
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert str(df.filter("s LIKE '%+02:00'").select(parse_date(df.s)).first()[0]) == "2024-01-05 08:00:00"
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
