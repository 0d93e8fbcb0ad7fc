import math

from tablewright.config import Config
from tablewright.operators import broken, categories, constants, duplicates, formats, missing, outliers, profile
from tablewright.operators.rows import with_row_id
from tablewright.operators.scan import scan_table


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_missing_profile(spark):
    df = spark.createDataFrame([(None, 1.0), ("", float("nan")), (" ", None), ("\t", 2.0), ("-", 3.0), ("x", 4.0)],
                               "a string, b double")
    got = {r.column_name: r for r in missing.missing_profile(df).collect()}
    a, b = got["a"], got["b"]
    assert (a.n_null, a.n_blank, a.n_placeholder, a.n_placeholder_or_null, a.n_missing) == (1, 3, 1, 2, 5)
    assert (b.n_null, b.n_missing, b.pct_missing) == (2, 2, 33.33)


def test_scan_agrees_with_detectors(messy):
    scan = scan_table(messy, as_of="2024-01-01")
    for r in missing.missing_profile(messy).collect():
        assert scan.missing[r.column_name]["n_missing"] == r.n_missing
    assert {(c, k): set(v) for (c, k), v in scan.formats.items() if len(v) > 1} == {
        (r.column_name, r.check_name): set(r.labels.split(", ")) for r in formats.format_issues(messy).collect()}
    assert scan.broken == {(r.column_name, r.rule): r.n
                           for r in broken.broken_counts(messy, as_of="2024-01-01").collect()}


def test_broken_rules(spark):
    df = with_row_id(spark.createDataFrame([
        (1, "150", "a@b.co", "(555) 123-4567", "2030-01-01"), (2, "151", "a@b", "call", "31/12/2000"),
        (3, "-1", None, None, None), (4, "old", "x y@z.org", "123456", "2001-05-05")],
        "k bigint, age string, email string, phone string, birth_date string"), "k")
    got = rows(broken.violations(df, as_of="2024-01-01"))
    assert got == {("age", "invalid_ages", 2, "151"), ("age", "invalid_ages", 3, "-1"),
                   ("email", "invalid_emails", 2, "a@b"), ("email", "invalid_emails", 4, "x y@z.org"),
                   ("phone", "invalid_phones", 2, "call"), ("phone", "invalid_phones", 4, "123456"),
                   ("birth_date", "unparseable_dates", 2, "31/12/2000"),
                   ("birth_date", "future_birth_dates", 1, "2030-01-01")}
    assert {r.rule for r in broken.broken_examples(df, 1, as_of="2024-01-01").collect()} == {g[1] for g in got}


def test_numeric_phone_keeps_its_digits(spark):
    df = with_row_id(spark.createDataFrame([(1, 5551234567.0), (2, 5.0)], "k bigint, phone double"), "k")
    assert rows(broken.violations(df)) == {("phone", "invalid_phones", 2, "5.0")}


def test_duplicates_with_nested_columns(spark):
    df = spark.createDataFrame([(1, "a", [1], {"x": 1}), (1, "a", [1], {"x": 1}), (1, "a", [1], {"x": 2}),
                                (None, None, None, None), (None, None, None, None)],
                               "k long, s string, arr array<int>, m map<string,int>").coalesce(1)
    one = duplicates.exact_duplicates(df).first()
    assert (one.n_rows, one.n_duplicates, one.n_duplicate_groups) == (5, 2, 2)
    assert duplicates.drop_duplicates(df).count() == 3
    assert duplicates.drop_duplicates(df).schema == df.schema


def test_duplicate_rows_and_first_id(spark):
    data = [(0, "a"), (1, "b"), (2, "a"), (3, "c"), (4, "b"), (5, "a")]
    df = spark.createDataFrame(data, "_row_id bigint, s string").repartition(3)
    assert [r._row_id for r in duplicates.duplicate_rows(df).collect()] == [0, 1, 2, 4, 5]
    assert [r._row_id for r in duplicates.duplicate_rows(df, 3).collect()] == [0, 1, 2]
    assert rows(duplicates.drop_duplicates(df)) == {(0, "a"), (1, "b"), (3, "c")}


def test_nan_and_null_group_separately_but_repeat(spark):
    df = spark.createDataFrame([(float("nan"),), (float("nan"),), (None,), (None,), (0.0,), (-0.0,)], "v double")
    assert duplicates.exact_duplicates(df).first().n_duplicates == 3
    assert profile.distinct_counts(df).first().unique_count == 1


def test_outlier_edges(spark):
    nine = spark.createDataFrame([(float(i),) for i in range(8)] + [(1000.0,)], "v double")
    assert outliers.outlier_counts(nine).count() == 0
    ten = nine.union(spark.createDataFrame([(8.0,)], "v double"))
    r = outliers.outlier_counts(ten).first()
    assert (r.n_iqr, r.n_z) == (1, 0)
    flat = spark.createDataFrame([(1.0,)] * 30, "v double")
    assert outliers.outlier_counts(flat).count() == 0
    # No spread between the quartiles: everything else is beyond the fences.
    spike = flat.union(spark.createDataFrame([(2.0,)], "v double"))
    r = outliers.outlier_counts(spike).first()
    assert (r.n_iqr, r.n_z, r.lower_fence, r.upper_fence) == (1, 1, 1.0, 1.0)


def test_case_variants_and_canonical(spark):
    df = spark.createDataFrame([("Sales",), ("sales",), ("SALES ",), ("sales",), ("HR",), (None,)], "dept string")
    got = rows(categories.case_variants(df))
    assert got == {("dept", "sales", "Sales", 1), ("dept", "sales", "sales", 2), ("dept", "sales", "SALES ", 1)}
    assert categories.case_variants(df, trim=False).count() == 2
    fixed = [r.dept for r in categories.apply_canonical_spelling(df, "dept").collect()]
    assert sorted(str(v) for v in fixed) == sorted(["sales"] * 4 + ["HR", "None"])


def test_near_constant_shares(spark):
    n = 1000
    data = [("a" if i >= 5 else f"x{i}", "a" if i >= 6 else "b", None, i, None if i >= 4 else "z", float(i > 4)) for i in range(n)]
    df = spark.createDataFrame(data, "at string, under string, allnull string, uniq int, mostnull string, num double").repartition(6)
    got = constants.top_shares(df)
    assert got == {"at": 0.995, "allnull": 1.0, "mostnull": 0.996, "num": 0.995}
    assert constants.top_shares(df.limit(1)) == {}


def test_profile_pieces(spark):
    df = with_row_id(spark.createDataFrame(
        [(i, float(i) if i % 4 else None, "ab"[i % 2]) for i in range(20)], "k bigint, v double, s string"), "k")
    assert profile.shape(df).first().asDict() == {
        "n_rows": 20, "n_columns": 3, "n_cells": 60, "text_bytes": 20 * 8 + 15 * 8 + 20, "types": "bigint:1, double:1, string:1"}
    r = {x.column_name: x for x in profile.numeric_profile(df).collect()}["v"]
    vals = [i for i in range(20) if i % 4]
    mean = sum(vals) / len(vals)
    assert (r.min, r.max, r.mean, r.median) == (1.0, 19.0, mean, 10.0)
    assert math.isclose(r.std, (sum((v - mean) ** 2 for v in vals) / 14) ** .5, abs_tol=1e-4)
    ends = profile.head_tail(df, 2).collect()
    assert sorted((x.part, x.k) for x in ends) == [("head", 0), ("head", 1), ("tail", 18), ("tail", 19)]
    assert [(x.rank, x.value, x.n) for x in profile.top_values(df, 2).orderBy("rank").collect()] == [(1, "a", 10), (2, "b", 10)]
    approx = {x.column_name: x.unique_count for x in profile.distinct_counts(df, approximate=True).collect()}
    assert approx["s"] == 2


def test_results_do_not_depend_on_partitions(messy):
    one, many = messy.coalesce(1), messy.repartition(8)
    for f in (missing.missing_profile, duplicates.exact_duplicates, formats.format_issues,
              lambda d: broken.broken_counts(d, as_of="2024-01-01"), categories.case_variants, profile.distinct_counts):
        assert rows(f(one)) == rows(f(many))


def test_wide_tables_split_into_passes(spark, monkeypatch):
    from tablewright.operators import rows as r
    monkeypatch.setattr(r, "AGGREGATES_PER_PASS", 10)
    df = spark.createDataFrame([tuple(range(15))], ", ".join(f"c{i} bigint" for i in range(15)))
    assert missing.missing_profile(df).count() == 15
    assert scan_table(df, Config()).n_rows == 1
