"""One query per operator; each reads whole tables and returns a DataFrame."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import Config, Rule
from ..operators import (broken, categories, constants, duplicates, formats, missing,
                         outliers, profile, repairs, similarity, text_lsh)
from ..operators.repairs import Action, apply_actions
from ..operators.rows import ROW_ID, col, with_row_id
from ..plans import cleaning, decisions, fitting, validation
from ..session import ensure_checkpoint_dir
from ..sources import files, sinks
from .views import duplicated, duplicated_with_id, table, view

AS_OF = "1999-01-01 00:00:00"
CFG = Config()
REFINE = Config(exact_quantile_rows=1_000)      # forces the bracket refinement
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(col(n), 4) for n in names})


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


# --- sources and sinks -------------------------------------------------------

@query
def s1_s2_csv_round_trip(spark, sf):
    path = scratch(spark, "csv")
    sinks.write_csv(table(spark, sf, "customer"), f"{path}/nested/customer")
    return files.combine(files.load_directory(spark, path, ["csv"]).frames())


@query
def s3_csv_na_tokens(spark, sf):
    path = scratch(spark, "na")
    sinks.write_csv(view(spark, sf, "dirty_customer"), path)
    return files.combine(files.load_directory(spark, path, ["csv"]).frames())


@query
def s4_json_round_trip(spark, sf):
    path = scratch(spark, "json")
    table(spark, sf, "events").withColumn("ts", F.col("ts").cast("string")).withColumnRenamed("ts", "created_at").write.json(path)
    return files.combine(files.load_directory(spark, path, ["json"]).frames())


@query
def s2_csv_quoted_breaks(spark, sf):
    path = scratch(spark, "quoted")
    (table(spark, sf, "documents").write.option("header", True).option("quoteAll", True).option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    return files.combine(files.load_directory(spark, path, ["csv"]).frames())


@query
def s4_json_array(spark, sf):
    path = scratch(spark, "array")
    sinks.write_json_array(table(spark, sf, "events").withColumn("ts", F.col("ts").cast("string")).withColumnRenamed("ts", "created_at"), path)
    return files.combine(files.load_directory(spark, path, ["json"]).frames())


@query
def s4_json_columns(spark, sf):
    path = scratch(spark, "columns")
    sinks.write_json_columns(table(spark, sf, "customer"), path)
    return files.combine(files.load_directory(spark, path, ["json"]).frames())


@query
def s5_delimited_text(spark, sf):
    path = scratch(spark, "txt")
    sinks.write_delimited_text(table(spark, sf, "part"), path, ";")
    return files.combine(files.load_directory(spark, path, ["txt"]).frames())


@query
def s8_union_files(spark, sf):
    orders = table(spark, sf, "orders")
    first = orders.select("o_orderkey", "o_custkey", "o_totalprice")
    second = orders.select("o_orderkey", F.col("o_custkey").cast("string").alias("o_custkey"), "o_orderstatus")
    return files.combine([first, second])


@query
def k1_parquet_sink(spark, sf):
    path = scratch(spark, "parquet")
    sinks.write_parquet(view(spark, sf, "dirty_orders"), path)
    return spark.read.parquet(path)


# --- profiling ---------------------------------------------------------------

@query
def p1_p3_shape(spark, sf):
    return profile.shape(table(spark, sf, "events"))


@query
def p4_head_tail(spark, sf):
    return profile.head_tail(with_row_id(table(spark, sf, "customer"), "c_custkey"))


@query
def p5_null_profile(spark, sf):
    return profile.null_profile(view(spark, sf, "sparse_events"))


@query
def p6_distinct_counts(spark, sf):
    return profile.distinct_counts(table(spark, sf, "part"))


@query
def p7_sample_values(spark, sf):
    return profile.sample_values(with_row_id(view(spark, sf, "dirty_customer"), "c_custkey"))


@query
def p8_numeric_profile(spark, sf):
    return profile.numeric_profile(table(spark, sf, "lineitem"))


@query
def p8_numeric_profile_refined(spark, sf):
    return profile.numeric_profile(table(spark, sf, "lineitem"), REFINE)


@query
def p9_top_values(spark, sf):
    return profile.top_values(table(spark, sf, "part"))


# --- missing values ----------------------------------------------------------

@query
def m1_m4_missing_profile(spark, sf):
    return missing.missing_profile(view(spark, sf, "dirty_customer"))


@query
def m6_missing_examples(spark, sf):
    return missing.missing_examples(with_row_id(view(spark, sf, "dirty_customer"), "c_custkey"))


# --- formats -----------------------------------------------------------------

@query
def f2_lexical_types(spark, sf):
    return formats.format_counts(view(spark, sf, "dirty_orders"), checks=("mixed_types",))


@query
def f3_date_format_mix(spark, sf):
    return formats.format_counts(view(spark, sf, "dirty_orders"), checks=("multiple_date_formats",))


@query
def f4_date_separators(spark, sf):
    return formats.format_counts(view(spark, sf, "dirty_orders"), checks=("date_separators",))


@query
def f5_numeric_format_mix(spark, sf):
    return formats.format_counts(view(spark, sf, "dirty_orders").select("amount"), checks=("multiple_numeric_formats",))


@query
def f2_json_types(spark, sf):
    return formats.json_types(view(spark, sf, "mixed_events"))


@query
def f1_format_issues(spark, sf):
    return formats.format_issues(view(spark, sf, "dirty_orders"),
                                 checks=("multiple_date_formats", "multiple_numeric_formats"))


# --- broken entries ----------------------------------------------------------

@query
def b1_invalid_ages(spark, sf):
    return broken.violations(with_row_id(view(spark, sf, "dirty_customer"), "c_custkey"), rules=("invalid_ages",))


@query
def b1_age_by_substring(spark, sf):
    return broken.violations(with_row_id(table(spark, sf, "pages"), "page_id"), rules=("invalid_ages",))


@query
def b2_invalid_emails(spark, sf):
    return broken.violations(with_row_id(view(spark, sf, "dirty_customer"), "c_custkey"), rules=("invalid_emails",))


@query
def b4_invalid_phones(spark, sf):
    df = with_row_id(view(spark, sf, "dirty_customer"), "c_custkey").select(ROW_ID, "contact_phone")
    return broken.violations(df, rules=("invalid_phones",))


@query
def b5_unparseable_dates(spark, sf):
    return broken.violations(with_row_id(view(spark, sf, "dirty_orders"), "o_orderkey"), rules=("unparseable_dates",))


@query
def b6_future_births(spark, sf):
    return broken.violations(with_row_id(view(spark, sf, "births"), "o_orderkey"), as_of=AS_OF,
                             rules=("future_birth_dates",))


@query
def b_broken_counts(spark, sf):
    return broken.broken_counts(view(spark, sf, "dirty_customer"))


@query
def b7_broken_examples(spark, sf):
    return broken.broken_examples(with_row_id(view(spark, sf, "dirty_customer"), "c_custkey"))


# --- duplicates and similarity -----------------------------------------------

@query
def d1_exact_duplicates(spark, sf):
    return duplicates.exact_duplicates(duplicated(spark, sf, "dup_lineitem"))


@query
def d2_duplicate_rows(spark, sf):
    return duplicates.duplicate_rows(duplicated_with_id(spark, sf))


@query
def d3_approximate_duplicates(spark, sf):
    return duplicates.approximate_duplicates(duplicated(spark, sf, "dup_lineitem"))


@query
def d4_near_pairs(spark, sf):
    return similarity.near_pairs(view(spark, sf, "near_part"))


@query
def d4_near_pairs_customers(spark, sf):
    return similarity.near_pairs(table(spark, sf, "customer"))


@query
def d4_near_texts(spark, sf):
    return text_lsh.near_text_groups(table(spark, sf, "documents"), "doc_id", "text")


@query
def d5_key_repeats(spark, sf):
    return duplicates.key_repeats(view(spark, sf, "near_part"))


# --- outliers ----------------------------------------------------------------

@query
def o2_zscore_outliers(spark, sf):
    return outliers.outlier_rows(with_row_id(table(spark, sf, "events"), "event_id"), "z", columns=["value"])


@query
def o3_iqr_outliers(spark, sf):
    return outliers.outlier_rows(with_row_id(table(spark, sf, "events"), "event_id"), "iqr", columns=["value"])


@query
def o3_iqr_outliers_refined(spark, sf):
    return outliers.outlier_rows(with_row_id(table(spark, sf, "events"), "event_id"), "iqr", REFINE, ["value"])


@query
def o4_outlier_counts(spark, sf):
    return outliers.outlier_counts(view(spark, sf, "sparse_events"))


@query
def o4_outlier_examples(spark, sf):
    return outliers.outlier_examples(with_row_id(view(spark, sf, "sparse_events"), "event_id"))


# --- categories, whole scan, decisions -----------------------------------------

@query
def c1_case_variants(spark, sf):
    return categories.case_variants(view(spark, sf, "dirty_customer"))


@query
def c1_variant_groups(spark, sf):
    return categories.variant_groups(view(spark, sf, "near_part"))


@query
def c2_case_variants_untrimmed(spark, sf):
    return categories.case_variants(view(spark, sf, "near_part"), trim=False, k=10)


@query
def c3_issue_count(spark, sf):
    issues = decisions.identify(view(spark, sf, "dirty_customer"))
    return spark.createDataFrame(list(issues.counts().items()) + [("total", issues.total)], "kind string, n bigint")


@query
def r1_r10_decisions(spark, sf):
    found = cleaning.decide(view(spark, sf, "dirty_customer"), order_by="c_custkey")
    return decisions.decisions_frame(spark, found).select("step", "op", "column_name", "changed", "retyped")


@query
def r1_r3_missing_decisions(spark, sf):
    found = cleaning.fit_step(view(spark, sf, "sparse_events"), "fix_missing")[1]
    return decisions.decisions_frame(spark, found).select("op", "column_name", "changed", F.get_json_object("evidence", "$.how").alias("how"))


def _decided(spark, df, step, config=CFG):
    """What one step decides on a view, and what it changes."""
    found = cleaning.fit_step(df, step, config)[1]
    return decisions.decisions_frame(spark, found).select("step", "op", "column_name", "changed", "retyped")


# Rules of one's own: on discounts with a replacement, on keys as a report only.
OWN_RULES = Config(rules=(Rule("discount_too_high", "{value} > 0.08", words=("discount",), repair="0.08"),
                          Rule("odd_key", "{value} % 2 = 1", columns=("l_orderkey",), repair=None)))


@query
def rule_counts(spark, sf):
    return broken.broken_counts(table(spark, sf, "lineitem"), OWN_RULES, AS_OF)


@query
def rule_repair(spark, sf):
    df = table(spark, sf, "lineitem")
    return apply_actions(df, fitting.fit_domains(df, OWN_RULES), OWN_RULES)


@query
def r4_date_decision(spark, sf):
    return _decided(spark, with_row_id(view(spark, sf, "dirty_orders"), "o_orderkey"), "fix_formats")


@query
def r5_number_decision(spark, sf):
    return _decided(spark, with_row_id(view(spark, sf, "money_orders"), "o_orderkey"), "fix_formats")


@query
def r7_duplicate_decision(spark, sf):
    return _decided(spark, duplicated(spark, sf, "dup_orders"), "fix_duplicates")


@query
def r8_near_duplicate_decision(spark, sf):
    return _decided(spark, with_row_id(view(spark, sf, "near_part"), "p_partkey"), "fix_duplicates")


@query
def r9_outlier_decision(spark, sf):
    return _decided(spark, with_row_id(table(spark, sf, "events"), "event_id"), "fix_broken_entries")


# --- repairs -------------------------------------------------------------------

@query
def x1_null_placeholders(spark, sf):
    return repairs.null_placeholders(view(spark, sf, "dirty_customer"))


@query
def x2_x3_impute_numeric(spark, sf):
    return rounded(cleaning.fix_missing(view(spark, sf, "sparse_events")), "value", "value2", "value4")


@query
def x3_impute_numeric_refined(spark, sf):
    return rounded(cleaning.fix_missing(view(spark, sf, "sparse_events"), REFINE), "value", "value2", "value4")


@query
def x4_impute_dates(spark, sf):
    return cleaning.fix_missing(view(spark, sf, "sparse_events").select("event_id", "seen_at"))


@query
def x5_impute_mode(spark, sf):
    return cleaning.fix_missing(view(spark, sf, "dirty_customer"))


@query
def x6_ascii_fold(spark, sf):
    df = table(spark, sf, "documents")
    return apply_actions(df, fitting.fit_encoding(df))


@query
def x7_iso_dates(spark, sf):
    return cleaning.fix_formats(view(spark, sf, "dirty_orders"))


@query
def x8_normalise_numbers(spark, sf):
    return cleaning.fix_formats(table(spark, sf, "part"))


@query
def x9_timestamps_to_iso(spark, sf):
    return cleaning.fix_formats(table(spark, sf, "events").select("event_id", "ts"))


@query
def x10_nullify_broken(spark, sf):
    df = view(spark, sf, "dirty_customer")
    return apply_actions(df, fitting.fit_domains(df))


@query
def x11_cap_outliers(spark, sf):
    return rounded(cleaning.fix_broken_entries(table(spark, sf, "events")), "value")


@query
def x12_text_case(spark, sf):
    df = view(spark, sf, "messy_names").select("Part Key", "p-name")
    upper = table(spark, sf, "pages").select("page_id", F.upper("url").alias("url"))
    titled = cleaning.fix_text_consistency(df).select(F.col("`Part Key`").alias("key"), F.col("`p-name`").alias("value"))
    return titled.unionByName(cleaning.fix_text_consistency(upper).select(F.col("page_id").alias("key"), F.col("url").alias("value")))


@query
def x13_snake_case(spark, sf):
    return repairs.snake_case(view(spark, sf, "messy_names"))


@query
def x13_x15_column_names(spark, sf):
    return cleaning.fix_column_names(view(spark, sf, "messy_names"))


@query
def x14_constant_shares(spark, sf):
    shares = constants.top_shares(view(spark, sf, "messy_names"))
    return spark.createDataFrame([(c, round(s, 6)) for c, s in shares.items()], "column_name string, share double")


@query
def x15_integral_cast(spark, sf):
    df = table(spark, sf, "lineitem")
    return apply_actions(df, fitting.fit_integral(df))


@query
def x16_drop_duplicates(spark, sf):
    return duplicates.drop_duplicates(duplicated(spark, sf, "dup_orders"))


@query
def x17_near_flags_any_earlier(spark, sf):
    df = with_row_id(view(spark, sf, "near_part"), "p_partkey")
    return similarity.flag_near_duplicates(df, Config(near_duplicate_mode="any_earlier", near_duplicate_window=300)).drop(ROW_ID)


@query
def x17_near_flags_whole_table(spark, sf):
    df = with_row_id(view(spark, sf, "near_part"), "p_partkey")
    return similarity.flag_near_duplicates(df).drop(ROW_ID)


@query
def x17_near_flags_greedy(spark, sf):
    df = with_row_id(view(spark, sf, "near_part"), "p_partkey")
    return similarity.flag_near_duplicates(df, Config(near_duplicate_mode="greedy", near_duplicate_window=300)).drop(ROW_ID)


@query
def x17_near_flags_greedy_table(spark, sf):
    df = with_row_id(view(spark, sf, "near_part"), "p_partkey")
    return similarity.flag_near_duplicates(df, Config(near_duplicate_mode="greedy")).drop(ROW_ID)


@query
def x18_money(spark, sf):
    return repairs.normalise_money(view(spark, sf, "dirty_orders"))


@query
def x19_canonical_spelling(spark, sf):
    return categories.apply_canonical_spelling(view(spark, sf, "dirty_orders"), "o_orderpriority")


@query
def x20_parse_dates(spark, sf):
    return repairs.parse_dates(view(spark, sf, "dirty_orders"))


@query
def x22_recheck(spark, sf):
    df = view(spark, sf, "dirty_customer")
    _, _, facts = repairs.applied(df, fitting.fit_nulls(df, Config()))
    return spark.createDataFrame([(facts["rows"], facts["missing_cells"])], "n_rows bigint, missing_cells bigint")


# --- validation and whole runs ---------------------------------------------------

@query
def v1_v3_validate(spark, sf):
    before = view(spark, sf, "dirty_customer")
    after = apply_actions(before, fitting.fit_domains(before))
    v = validation.validate(before, after)
    rows = [("missing", c, n) for c, n in v.missing.items()] + [("broken", c, n) for c, n in v.broken.items()]
    rows += [("iqr_outliers", c, o["n_iqr"]) for c, o in v.outliers.items() if o["n_iqr"]]
    return spark.createDataFrame(rows + [("issues_remain", "", int(v.issues_remain))], "kind string, key string, n bigint")


@query
def v2_before_after(spark, sf):
    df = duplicated(spark, sf, "dup_lineitem")
    return validation.before_after(df, duplicates.drop_duplicates(df).drop("l_tax"))


@query
def v5_clean_full(spark, sf):
    return cleaning.clean(view(spark, sf, "dirty_customer"), order_by="c_custkey", as_of=AS_OF).df


@query
def v5_clean_recommended(spark, sf):
    return cleaning.clean(view(spark, sf, "dirty_orders"), Config.recommended(), order_by="o_orderkey", as_of=AS_OF).df


@query
def v6_v7_summary(spark, sf):
    df = duplicated(spark, sf, "dup_orders")
    s = cleaning.clean(df, as_of=AS_OF).summary()
    return spark.createDataFrame(
        [(s["rows"]["before"], s["rows"]["after"], s["rows"]["before"] - s["rows"]["after"], s["duplicate_rows"], s["rows_kept_pct"])],
        "rows_before bigint, rows_after bigint, rows_removed bigint, exact_duplicates bigint, quality_score int")


@query
def v8_n1_analyze(spark, sf):
    issues, _ = cleaning.analyze(view(spark, sf, "dirty_orders"), order_by="o_orderkey", as_of=AS_OF)
    return sinks.issues_frame(spark, issues)


