"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from ..config import EMAIL_PATTERN, PHONE_PATTERN, PLACEHOLDERS
from ..sources.files import NA_TOKENS
from .views import view_sql

DC, DO, SE, NP = (view_sql(v) for v in ("dirty_customer", "dirty_orders", "sparse_events", "near_part"))
MN, BI, DL, DP, MO, ME = (view_sql(v) for v in ("messy_names", "births", "dup_lineitem", "dup_orders", "money_orders", "mixed_events"))

TOKENS = "(" + ", ".join(f"'{t}'" for t in PLACEHOLDERS) + ")"
DC_COLUMNS = ["c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment", "contact_email", "contact_phone", "cust_age"]
DC_TEXT = ["c_mktsegment", "contact_email", "contact_phone"]


def union(parts) -> str:
    return " UNION ALL ".join(parts)


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"


def parse_date(c: str) -> str:
    return f"try_strptime({c}, ['%Y-%m-%d', '%m/%d/%Y', '%m-%d-%Y'])"


def money(c: str) -> str:
    return f"TRY_CAST(nullif(regexp_replace({c}, '[^0-9.\\-]+', '', 'g'), '') AS DOUBLE)"


def null_token(c: str) -> str:
    return f"CASE WHEN {c} NOT IN ({', '.join(repr(t) for t in NA_TOKENS)}) THEN {c} END AS {c}"


def decided(step: str, op: str, column: str, changes: str, source: str, retyped: str = "") -> str:
    return (f"SELECT '{step}' AS step, '{op}' AS op, '{column}' AS column_name, count(*) FILTER ({changes}) AS changed, "
            f"'{retyped}' AS retyped FROM {source}")


def null_out(c: str) -> str:
    return f"CASE WHEN {c} = '' OR lower({strip(c)}) IN {TOKENS} THEN NULL ELSE {c} END"


def missing_row(c: str, text: bool) -> str:
    blank = f"coalesce({strip(c)} = '', false)" if text else "false"
    token = f"coalesce(lower({strip(c)}) IN {TOKENS}, false)" if text else "false"
    return (f"SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) FILTER ({c} IS NULL) AS n_null, "
            f"count(*) FILTER ({blank}) AS n_blank, count(*) FILTER ({token}) AS n_placeholder, "
            f"count(*) FILTER ({token} OR {c} IS NULL) AS n_placeholder_or_null, "
            f"count(*) FILTER ({c} IS NULL OR {blank} OR {token}) AS n_missing, "
            f"round(count(*) FILTER ({c} IS NULL OR {blank} OR {token}) * 100.0::DOUBLE / count(*), 2) AS pct_missing "
            f"FROM {DC} t")


def numeric_row(table: str, c: str) -> str:
    return (f"SELECT '{c}' AS column_name, round(min({c})::DOUBLE, 4) AS min, round(max({c})::DOUBLE, 4) AS max, "
            f"round(avg({c}::DOUBLE), 4) AS mean, round(quantile_cont({c}::DOUBLE, 0.5), 4) AS median, "
            f"round(stddev_samp({c}::DOUBLE), 4) AS std FROM {table}")


LINEITEM_NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                    "l_extendedprice", "l_discount", "l_tax"]
NUMERIC = union(numeric_row("lineitem", c) for c in LINEITEM_NUMBERS)


def violations(table: str, key: str, rule: str, column: str, bad: str) -> str:
    return (f"SELECT '{column}' AS column_name, '{rule}' AS rule, {key} AS _row_id, "
            f"CAST({column} AS VARCHAR) AS value FROM {table} t WHERE {bad}")


BAD_AGE = "cust_age < 0 OR cust_age > 150"
BAD_EMAIL = f"NOT regexp_matches(contact_email, '{EMAIL_PATTERN}')"


def bad_phone(c: str) -> str:
    return f"NOT regexp_matches({c}, '{PHONE_PATTERN}')"


# contact_email carries a phone keyword as well, so both rules apply to it.
ALL_VIOLATIONS = union([
    violations(DC, "c_custkey", "invalid_ages", "cust_age", BAD_AGE),
    violations(DC, "c_custkey", "invalid_emails", "contact_email", BAD_EMAIL),
    violations(DC, "c_custkey", "invalid_phones", "contact_email", bad_phone("contact_email")),
    violations(DC, "c_custkey", "invalid_phones", "contact_phone", bad_phone("contact_phone"))])


def fences(table: str, c: str) -> str:
    return (f"SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi, mu, sd FROM "
            f"(SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3, "
            f"avg({c}) AS mu, stddev_pop({c}) AS sd FROM {table} f)")


def outlier_rows(test: str) -> str:
    return (f"WITH f AS ({fences('events', 'value')}) SELECT 'value' AS column_name, event_id AS _row_id, value "
            f"FROM events, f WHERE {test}")


IQR = "value < lo OR value > hi"
Z = "abs((value - mu) / sd) > 3.0"


def outlier_count(c: str) -> str:
    return (f"SELECT '{c}' AS column_name, count(*) FILTER (abs(({c} - mu) / sd) > 3.0) AS n_z, "
            f"count(*) FILTER ({c} < lo OR {c} > hi) AS n_iqr, round(any_value(lo), 4) AS lower_fence, "
            f"round(any_value(hi), 4) AS upper_fence, {'true' if 'id' in c else 'false'} AS skipped_by_name "
            f"FROM {SE} t, ({fences(SE, c)}) f HAVING n_z > 0 OR n_iqr > 0")


def outlier_examples(c: str) -> str:
    return (f"SELECT '{c}' AS column_name, row_number() OVER (ORDER BY event_id)::INT AS rank, event_id AS _row_id, "
            f"{c} AS value FROM {SE} t, ({fences(SE, c)}) f WHERE {c} < lo OR {c} > hi QUALIFY rank <= 5")


def labels(table: str, c: str, check: str, cases: list[tuple[str, str]]) -> str:
    whens = " ".join(f"WHEN {cond} THEN '{label}'" for label, cond in cases)
    return (f"SELECT '{c}' AS column_name, '{check}' AS check_name, label, count(*) AS n FROM "
            f"(SELECT CASE {whens} END AS label FROM {table} t) WHERE label IS NOT NULL GROUP BY label")


def match(c: str, pattern: str) -> str:
    return f"regexp_matches({c}, '{pattern}')"


def lexical(c: str) -> list[tuple[str, str]]:
    s = strip(c)
    return [("integer", match(s, "^[+-]?[0-9]+$")),
            ("decimal", match(s, "^[+-]?([0-9]+\\.[0-9]*|\\.[0-9]+|[0-9]+(\\.[0-9]*)?[eE][+-]?[0-9]+)$")),
            ("boolean", f"lower({s}) IN ('true', 'false')"),
            ("date", f"{parse_date(c)} IS NOT NULL"), ("string", f"{c} IS NOT NULL")]


DATE_CASES = [("YYYY-MM-DD", match("order_date", "^[0-9]{4}-[0-9]{2}-[0-9]{2}")),
              ("MM/DD/YYYY", match("order_date", "^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}")),
              ("MM-DD-YYYY", match("order_date", "^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}"))]
SEPARATOR_CASES = [("MM/DD/YYYY or DD/MM/YYYY", f"{parse_date('order_date')} IS NOT NULL AND contains(order_date, '/')"),
                   ("YYYY-MM-DD or MM-DD-YYYY", f"{parse_date('order_date')} IS NOT NULL AND contains(order_date, '-')")]
NUMBER_CASES = [("comma_formatted", match("amount", "^\\$?[0-9]{1,3}(,[0-9]{3})*(\\.[0-9]+)?$")),
                ("currency_symbol", match("amount", "^\\$[0-9]+(\\.[0-9]+)?$")),
                ("plain_integer", match("amount", "^[0-9]+$")), ("decimal", match("amount", "^[0-9]+\\.[0-9]+$"))]
F3 = labels(DO, "order_date", "multiple_date_formats", DATE_CASES)
F5 = labels(DO, "amount", "multiple_numeric_formats", NUMBER_CASES)
ORDER_NUMBER_CASES = [(n, c.replace("amount", "order_date")) for n, c in NUMBER_CASES]


def issue_groups(*parts: str) -> str:
    return (f"SELECT column_name, check_name, count(*) AS n_labels, string_agg(label, ', ' ORDER BY label) AS labels, "
            f"concat(column_name, '_', check_name) AS issue FROM ({union(parts)}) GROUP BY column_name, check_name "
            f"HAVING count(*) > 1")


def variants(table: str, cols, key, extra: str = "") -> str:
    rows = union(f"SELECT '{c}' AS column_name, {key(c)} AS category, {c} AS variant, count(*) AS n "
                 f"FROM {table} t WHERE {c} IS NOT NULL GROUP BY ALL" for c in cols)
    return (f"SELECT column_name, category, variant, n FROM ({rows}) "
            f"QUALIFY count(*) OVER (PARTITION BY column_name, category) > 1 {extra}")


def lower_strip(c: str) -> str:
    return f"lower({strip(c)})"


def sort_key(c: str) -> str:
    return (f"array_to_string(list_sort(list_filter(string_split(regexp_replace(lower({c}), "
            f"'[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'), ' '), lambda x: x <> '')), ' ')")


def lcs_scores(table: str, c: str) -> str:
    """Bit-parallel LCS of all key pairs that pass the length bound."""
    return f"""
keys AS (SELECT {sort_key(c)} AS key, min({c}) AS v, count(*) AS n FROM {table} t GROUP BY 1),
pairs AS (SELECT a.key AS ka, b.key AS kb FROM keys a JOIN keys b ON a.key < b.key
          AND 400 * least(length(a.key), length(b.key)) >= 183 * (length(a.key) + length(b.key))),
steps AS (
  SELECT ka, kb, 1 AS j, (1::BIGINT << length(ka)) - 1 AS s FROM pairs
  UNION ALL
  SELECT ka, kb, j + 1, ((s + u) | (s - u)) & ((1::BIGINT << length(ka)) - 1) FROM (
    SELECT *, s & CAST(list_sum(list_transform(range(1, length(ka) + 1), lambda i:
      CASE WHEN ka[i] = kb[j] THEN 1::BIGINT << (i - 1)::INT ELSE 0::BIGINT END)) AS BIGINT) AS u
    FROM steps WHERE j <= length(kb))),
scores AS (SELECT ka, kb, round_even(200.0::DOUBLE * (length(ka) - bit_count(s)) / (length(ka) + length(kb)), 0)::INT AS score
           FROM steps WHERE j = length(kb) + 1)"""


def near_pairs(table: str, c: str) -> str:
    return (f"WITH RECURSIVE {lcs_scores(table, c)} SELECT '{c}' AS column_name, a.v AS a, b.v AS b, score, "
            f"a.n AS rows_a, b.n AS rows_b FROM scores JOIN keys a ON ka = a.key JOIN keys b ON kb = b.key "
            f"WHERE score BETWEEN 92 AND 99")


TITLE = ("array_to_string(list_transform(regexp_extract_all(lower({c}), '\\p{{L}}+|\\P{{L}}+'), "
         "lambda w: upper(w[1]) || w[2:]), '')")


def mode(table: str, c: str) -> str:
    return f"(SELECT {c} FROM {table} m WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"


X1 = ", ".join(f"{null_out(c)} AS {c}" if c in DC_TEXT else c for c in DC_COLUMNS)
EVENT_FENCES = fences("events", "value")


def exists(table: str, cond: str) -> str:
    return f"EXISTS (SELECT 1 FROM {table} t WHERE {cond})"


def imputation(table: str, c: str, how: str | None = None) -> str:
    """What becomes of a column with gaps: dropped above 60 %, else filled."""
    how = f"'{how}'" if how else "CASE WHEN p < 0.05 OR p >= 0.3 THEN 'median' ELSE 'mean' END"
    return (f"SELECT CASE WHEN p > 0.6 THEN 'drop_column' ELSE 'fill' END AS op, '{c}' AS column_name, "
            f"CASE WHEN p > 0.6 THEN 1 ELSE n END AS changed, CASE WHEN p <= 0.6 THEN {how} END AS how FROM "
            f"(SELECT count(*) FILTER ({c} IS NULL) AS n, count(*) FILTER ({c} IS NULL) / count(*)::DOUBLE AS p FROM {table} t) WHERE n > 0")


def has_outlier(c: str) -> str:
    return f"EXISTS (SELECT 1 FROM {DC} t, ({fences(DC, c)}) f WHERE {c} < lo OR {c} > hi OR abs(({c} - mu) / sd) > 3.0)"


def has_variants(c: str) -> str:
    return (f"EXISTS (SELECT {lower_strip(c)} FROM {DC} t WHERE {c} IS NOT NULL "
            f"GROUP BY 1 HAVING count(DISTINCT {c}) > 1)")


DC_NUMBERS = [c for c in DC_COLUMNS if c not in DC_TEXT]


def stage(name: str, source: str, changed: dict[str, str]) -> str:
    """A CTE: the source with some columns replaced."""
    return f"{name} AS (SELECT {', '.join(f'{changed[c]} AS {c}' if c in changed else c for c in DC_COLUMNS)} FROM {source} t)"


def effect(step: str, op: str, c: str, before: str, after: str) -> str:
    """Cells of a column that differ between two stages of the same rows."""
    return (f"SELECT '{step}' AS step, '{op}' AS op, '{c}' AS column_name, count(*) AS changed, '' AS retyped "
            f"FROM {before} a JOIN {after} b USING (c_custkey) WHERE a.{c} IS DISTINCT FROM b.{c} HAVING count(*) > 0")


STAGES = ", ".join([
    f"x0 AS (SELECT * FROM {DC} t)",
    stage("x1", "x0", {c: null_out(c) for c in DC_TEXT}),
    stage("x2", "x1", {c: f"coalesce({c}, {mode('x1', c)})" for c in DC_TEXT}),
    stage("x3", "x2", {c: f"nullif({strip(f'regexp_replace({c}, {chr(39)}[^\\x00-\\x7F]+{chr(39)}, {chr(39)*2}, {chr(39)}g{chr(39)})')}, 'nan')" for c in DC_TEXT}),
    stage("x4", "x3", {"contact_email": f"CASE WHEN NOT ({BAD_EMAIL}) THEN contact_email END",
                       "contact_phone": f"CASE WHEN NOT ({bad_phone('contact_phone')}) THEN contact_phone END",
                       "cust_age": "CASE WHEN cust_age BETWEEN 0 AND 120 THEN cust_age END"}),
    stage("x5", "x4", {"contact_email": "lower(contact_email)"})])
DECISIONS = f"WITH {STAGES} " + union(
    [effect("fix_missing", "null_placeholders", c, "x0", "x1") for c in DC_TEXT]
    + [effect("fix_missing", "fill", c, "x1", "x2") for c in DC_TEXT]
    + [effect("fix_formats", "fold_ascii", c, "x2", "x3") for c in DC_TEXT]
    + [effect("fix_broken_entries", op, c, "x3", "x4") for op, c in
       (("null_email", "contact_email"), ("null_phone", "contact_phone"), ("null_age", "cust_age"))]
    + [f"SELECT 'fix_broken_entries', 'cap', '{c}', count(*), 'bigint -> double' FROM x4, ({fences('x4', c)}) q "
       f"WHERE {c} < lo OR {c} > hi HAVING count(*) > 0" for c in DC_NUMBERS]
    + [effect("fix_text_consistency", "lower", "contact_email", "x4", "x5"),
       "SELECT 'fix_column_names', 'to_long', 'c_nationkey', 0, 'int -> bigint'"])


def flag(cond: str) -> str:
    return f"CAST(({cond}) AS BIGINT)"


def more_than_one(c: str, cases) -> str:
    return f"(SELECT count(*) > 1 FROM ({labels(DC, c, 'x', cases)}))"


N_MISSING = " + ".join(flag(exists(DC, f"{c} IS NULL OR {strip(c)} = '' OR lower({strip(c)}) IN {TOKENS}")) for c in DC_TEXT)
N_FORMATS = " + ".join(
    [flag(more_than_one(c, lexical(c))) for c in DC_TEXT]
    + [flag(more_than_one(c, [(n, x.replace("amount", c)) for n, x in NUMBER_CASES])) for c in DC_TEXT])
N_BROKEN = " + ".join(flag(exists(DC, b)) for b in (BAD_AGE, BAD_EMAIL, bad_phone("contact_email"), bad_phone("contact_phone")))
N_OUTLIER = " + ".join(flag(has_outlier(c)) for c in DC_COLUMNS if c not in DC_TEXT)
N_VARIANT = " + ".join(flag(has_variants(c)) for c in DC_TEXT)
COUNTS = (f"SELECT {N_MISSING} AS missing, {N_FORMATS} AS formats, {N_BROKEN} AS broken, 0::BIGINT AS exact_duplicates, "
          f"0::BIGINT AS near_duplicates, {N_VARIANT} AS contradictory, {N_OUTLIER} AS outliers")
KINDS = ("missing", "formats", "broken", "exact_duplicates", "near_duplicates", "contradictory", "outliers")


def imputed(c: str, how: str) -> str:
    fill = {"mean": f"avg({c})", "median": f"quantile_cont({c}, 0.5)"}[how]
    return f"round(coalesce({c}, (SELECT {fill} FROM {SE} m)), 4) AS {c}"


def fixed_customer() -> str:
    email = f"CASE WHEN regexp_matches(contact_email, '{EMAIL_PATTERN}') THEN contact_email END"
    phone = f"CASE WHEN regexp_matches(contact_phone, '{PHONE_PATTERN}') THEN contact_phone END"
    return (f"(SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment, {email} AS contact_email, "
            f"{phone} AS contact_phone, CASE WHEN cust_age BETWEEN 0 AND 120 THEN cust_age END AS cust_age FROM {DC} t)")


def validated() -> str:
    fixed = fixed_customer()
    missing = lambda c: (f"{c} IS NULL OR {strip(c)} = '' OR lower({strip(c)}) IN {TOKENS}"
                         if c in DC_TEXT else f"{c} IS NULL")
    rows = [f"SELECT 'missing' AS kind, '{c}' AS key, count(*) FILTER ({missing(c)}) AS n FROM {fixed} t HAVING n > 0"
            for c in DC_COLUMNS]
    # contact_email still breaks the phone rule that its name calls for.
    rows.append(f"SELECT 'broken', 'contact_email_invalid_phones', count(*) FILTER ({bad_phone('contact_email')}) "
                f"FROM {fixed} t")
    for c in DC_COLUMNS:
        if c not in DC_TEXT:
            rows.append(f"SELECT 'iqr_outliers', '{c}', count(*) FILTER ({c} < lo OR {c} > hi) AS n "
                        f"FROM {fixed} t, ({fences(fixed, c)}) f HAVING n > 0")
    rows.append("SELECT 'issues_remain', '', 1")
    return union(rows)


def text_bytes() -> str:
    return ("sum(8 + 8 + 8 + 8 + strlen(event_type) + strlen(props) + 0)")


SHARE = "round(max(n)::DOUBLE / sum(n), 6)"
IMPUTED = (f"SELECT event_id, event_type, {imputed('value', 'mean')}, {imputed('value2', 'median')}, {imputed('value4', 'median')}, "
           f"coalesce(seen_at, (SELECT list_sort(list(seen_at))[CAST(count(*) // 2 + 1 AS BIGINT)] FROM {SE} m WHERE seen_at IS NOT NULL)) AS seen_at FROM {SE} t")

ORACLES: dict[str, str] = {
    "s1_s2_csv_round_trip": "SELECT c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, c_acctbal, c_mktsegment FROM customer",
    "s3_csv_na_tokens": f"SELECT c_custkey, c_nationkey::BIGINT AS c_nationkey, c_acctbal, contact_email, contact_phone, cust_age, CASE WHEN c_mktsegment IN ('', 'N/A') THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM {DC} t",
    "s2_csv_quoted_breaks": f"SELECT doc_id, {null_token('text')}, {null_token('lang')}, {null_token('source')}, n_chars FROM documents",
    "s4_json_round_trip": "SELECT event_id, ts AS created_at, user_id, event_type, value, props FROM events",
    "s4_json_array": "SELECT event_id, ts AS created_at, user_id, event_type, value, props FROM events",
    "s4_json_columns": "SELECT c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, c_acctbal, c_mktsegment FROM customer",
    "s5_delimited_text": "SELECT p_partkey, p_name, p_brand, p_type, p_size::BIGINT AS p_size, p_retailprice FROM part",
    "s8_union_files": ("SELECT o_orderkey, o_custkey::VARCHAR AS o_custkey, o_totalprice, NULL::VARCHAR AS o_orderstatus FROM orders "
                       "UNION ALL SELECT o_orderkey, o_custkey::VARCHAR, NULL, o_orderstatus FROM orders"),
    "k1_parquet_sink": f"SELECT * FROM {DO} t",
    "p1_p3_shape": (f"SELECT count(*) AS n_rows, 6::BIGINT AS n_columns, count(*) * 6 AS n_cells, "
                    f"CAST({text_bytes()} AS BIGINT) AS text_bytes, "
                    f"'bigint:2, double:1, string:2, timestamp_ntz:1' AS types FROM events"),
    "p4_head_tail": ("SELECT * FROM (SELECT *, c_custkey AS _row_id, 'head' AS part FROM customer ORDER BY c_custkey LIMIT 5) "
                     "UNION ALL SELECT * FROM (SELECT *, c_custkey AS _row_id, 'tail' AS part FROM customer ORDER BY c_custkey DESC LIMIT 5)"),
    "p5_null_profile": union(
        f"SELECT '{c}' AS column_name, '{t}' AS data_type, count({c}) AS non_null, count(*) - count({c}) AS null_count, "
        f"round((count(*) - count({c})) * 100.0::DOUBLE / count(*), 2) AS null_pct FROM {SE} t"
        for c, t in (("event_id", "bigint"), ("event_type", "string"), ("value", "double"), ("value2", "double"),
                     ("value3", "double"), ("value4", "double"), ("seen_at", "timestamp_ntz"))),
    "p6_distinct_counts": union(f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS unique_count FROM part"
                                for c in ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")),
    "p7_sample_values": union(
        f"(SELECT '{c}' AS column_name, c_custkey AS _row_id, CAST({c} AS VARCHAR) AS value FROM {DC} t WHERE {c} IS NOT NULL "
        f"ORDER BY c_custkey LIMIT 5)" for c in DC_COLUMNS),
    "p8_numeric_profile": NUMERIC,
    "p8_numeric_profile_refined": NUMERIC,
    "p9_top_values": union(
        f"(SELECT '{c}' AS column_name, row_number() OVER (ORDER BY count(*) DESC, {c})::INT AS rank, {c} AS value, count(*) AS n "
        f"FROM part GROUP BY {c} QUALIFY rank <= 3)" for c in ("p_name", "p_brand", "p_type")),
    "m1_m4_missing_profile": union(missing_row(c, c in DC_TEXT) for c in DC_COLUMNS),
    "m6_missing_examples": union(
        f"(SELECT '{c}' AS column_name, c_custkey AS _row_id, {c} AS value FROM {DC} t WHERE {c} IS NULL "
        f"OR {strip(c)} = '' OR lower({strip(c)}) IN {TOKENS} ORDER BY c_custkey LIMIT 3)"
        for c in ("c_mktsegment", "contact_email")),
    "f2_lexical_types": union(labels(DO, c, "mixed_types", lexical(c)) for c in ("order_date", "amount", "o_orderpriority")),
    "f3_date_format_mix": F3,
    "f4_date_separators": labels(DO, "order_date", "date_separators", SEPARATOR_CASES),
    "f5_numeric_format_mix": F5,
    "f1_format_issues": issue_groups(F3, F5),
    "b1_invalid_ages": violations(DC, "c_custkey", "invalid_ages", "cust_age", BAD_AGE),
    "b1_age_by_substring": violations("pages", "page_id", "invalid_ages", "page_id", "page_id > 150"),
    "b2_invalid_emails": violations(DC, "c_custkey", "invalid_emails", "contact_email", BAD_EMAIL),
    "b4_invalid_phones": violations(DC, "c_custkey", "invalid_phones", "contact_phone", bad_phone("contact_phone")),
    "b5_unparseable_dates": violations(DO, "o_orderkey", "unparseable_dates", "order_date", f"{parse_date('order_date')} IS NULL"),
    "b6_future_births": violations(BI, "o_orderkey", "future_birth_dates", "birth_date", "CAST(birth_date AS TIMESTAMP) > TIMESTAMP '1999-01-01'"),
    "b_broken_counts": f"SELECT column_name, rule, count(*) AS n FROM ({ALL_VIOLATIONS}) GROUP BY 1, 2",
    "b7_broken_examples": (f"SELECT column_name, rule, row_number() OVER (PARTITION BY column_name, rule ORDER BY _row_id)::INT AS rank, "
                           f"_row_id, value FROM ({ALL_VIOLATIONS}) QUALIFY rank <= 5"),
    "d1_exact_duplicates": (f"SELECT sum(c)::BIGINT AS n_rows, sum(c - 1)::BIGINT AS n_duplicates, "
                            f"count(*) FILTER (c > 1) AS n_duplicate_groups FROM (SELECT *, count(*) AS c FROM {DL} t GROUP BY ALL)"),
    "d2_duplicate_rows": ("SELECT * FROM (SELECT 2 * o_orderkey + i AS _row_id, o.* FROM orders o, (VALUES (0), (1)) v(i) "
                          "WHERE o_orderkey % 50 = 0) ORDER BY _row_id LIMIT 20"),
    "d4_near_pairs": near_pairs(NP, "p_name"),
    "d4_near_pairs_customers": near_pairs("customer", "c_name"),
    # Every pair of texts that share a 5-word shingle, compared on whole sets; then the groups of the links of 0.8 or more.
    "d4_near_texts": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                     '[^\x20\x09-\x0D]+') AS w FROM documents),
             s AS (SELECT DISTINCT doc_id, hash(array_to_string(w[i : i + 4], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM w)),
             n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
             m AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
             l AS (SELECT a, b FROM m JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 5 * shared >= 4 * (x.n + y.n - shared)),
             e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
             r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
             g AS (SELECT a AS doc_id, min(b) AS group_id FROM r GROUP BY a)
        SELECT doc_id, group_id, count(*) OVER (PARTITION BY group_id) AS group_rows FROM g""",
    "d5_key_repeats": f"SELECT 'p_name' AS column_name, p_name AS value, count(*) AS n FROM {NP} t GROUP BY p_name HAVING count(*) > 1",
    "o2_zscore_outliers": outlier_rows(Z),
    "o3_iqr_outliers": outlier_rows(IQR),
    "o3_iqr_outliers_refined": outlier_rows(IQR),
    "o4_outlier_counts": union(f"({outlier_count(c)})" for c in ("event_id", "value", "value2", "value3", "value4")),
    "o4_outlier_examples": union(f"({outlier_examples(c)})" for c in ("value", "value2", "value3", "value4")),
    "c1_case_variants": variants(DC, DC_TEXT, lower_strip),
    "c1_variant_groups": (f"SELECT column_name, category, count(*) AS n_variants, sum(n)::BIGINT AS n_rows FROM "
                          f"({variants(NP, ['p_name'], lower_strip)}) GROUP BY 1, 2"),
    "c2_case_variants_untrimmed": variants(NP, ["p_name"], lambda c: f"lower({c})",
                                           "AND row_number() OVER (PARTITION BY column_name, category ORDER BY variant) <= 10"),
    "c3_issue_count": (f"WITH c AS ({COUNTS}) " + union(f"SELECT '{k}' AS kind, {k} AS n FROM c" for k in KINDS)
                       + f" UNION ALL SELECT 'total', {' + '.join(KINDS)} FROM c"),
    "r1_r10_decisions": DECISIONS,
    "r1_r3_missing_decisions": union([imputation(SE, c) for c in ("value", "value2", "value3", "value4")]
                                     + [imputation(SE, "seen_at", "median_date")]),
    "x1_null_placeholders": f"SELECT {X1} FROM {DC} t",
    "x2_x3_impute_numeric": IMPUTED,
    "x3_impute_numeric_refined": IMPUTED,
    "x4_impute_dates": (f"SELECT event_id, coalesce(seen_at, (SELECT list_sort(list(seen_at))[CAST(count(*) // 2 + 1 AS BIGINT)] "
                        f"FROM {SE} m WHERE seen_at IS NOT NULL)) AS seen_at FROM {SE} t"),
    "x5_impute_mode": f"WITH {STAGES} SELECT * FROM x2",
    "x6_ascii_fold": ("SELECT doc_id, lang, source, n_chars, nullif(trim(regexp_replace(text, '[^\\x00-\\x7F]+', '', 'g'), ' \t\n\r\x0b\x0c'), 'nan') AS text "
                      "FROM documents"),
    "x7_iso_dates": f"SELECT o_orderkey, strftime({parse_date('order_date')}, '%Y-%m-%d') AS order_date, amount, o_orderpriority FROM {DO} t",
    "x8_normalise_numbers": (f"SELECT p_partkey, p_name, {money('p_brand')} AS p_brand, p_type, p_size, p_retailprice FROM part"),
    "x9_timestamps_to_iso": "SELECT event_id, strftime(ts, '%Y-%m-%d') AS ts FROM events",
    "x10_nullify_broken": f"SELECT * FROM {fixed_customer()} t",
    "x11_cap_outliers": f"SELECT event_id, ts, user_id, event_type, props, round(greatest(lo, least(hi, value)), 4) AS value FROM events, ({EVENT_FENCES}) f",
    "x12_text_case": (f"SELECT \"Part Key\" AS key, {TITLE.format(c='\"p-name\"')} AS value FROM {MN} t "
                      f"UNION ALL SELECT page_id, lower(upper(url)) FROM pages"),
    "x13_snake_case": ("SELECT \"Part Key\" AS part_key, \"p-name\" AS p_name, \"p.name\" AS p_name_2, \" Brand \" AS brand, "
                       f"\"Half  Full\" AS half_full, nothing, size, p_retailprice FROM {MN} t"),
    "x13_x15_column_names": ("SELECT \"Part Key\" AS part_key, \"p-name\" AS p_name, \"p.name\" AS p_name_2, "
                             f"\"Half  Full\" AS half_full, size::BIGINT AS size, p_retailprice FROM {MN} t"),
    "x14_constant_shares": union(
        f"SELECT '{c}' AS column_name, {SHARE} AS share FROM (SELECT count(*) AS n FROM {MN} t GROUP BY \"{c}\") HAVING max(n) >= 0.995 * sum(n)"
        for c in (" Brand ", "Half  Full", "nothing", "size")),
    "x15_integral_cast": "SELECT * REPLACE (l_linenumber::BIGINT AS l_linenumber, l_quantity::BIGINT AS l_quantity) FROM lineitem",
    "x16_drop_duplicates": f"SELECT DISTINCT * FROM {DP} t",
    "f2_json_types": (
        f"WITH j AS (SELECT payload::JSON AS j FROM {ME} t WHERE json_valid(payload) AND json_type(payload) = 'OBJECT'), "
        f"k AS (SELECT unnest(json_keys(j)) AS key, j FROM j), "
        f"v AS (SELECT key, json_type(json_extract(j, '$.' || key)) AS kind FROM k) "
        f"SELECT 'payload' AS column_name, key, CASE WHEN kind IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN 'number' WHEN kind = 'VARCHAR' THEN 'text' "
        f"ELSE lower(kind) END AS kind, count(*) AS n FROM v GROUP BY ALL"),
    "rule_counts": ("SELECT 'l_discount' AS column_name, 'discount_too_high' AS rule, count(*) FILTER (l_discount > 0.08::DOUBLE) AS n FROM lineitem "
                    "UNION ALL SELECT 'l_orderkey', 'odd_key', count(*) FILTER (l_orderkey % 2 = 1) FROM lineitem"),
    "rule_repair": "SELECT * REPLACE (CASE WHEN l_discount > 0.08::DOUBLE THEN 0.08::DOUBLE ELSE l_discount END AS l_discount) FROM lineitem",
    "r4_date_decision": decided("fix_formats", "to_date", "order_date", f"order_date IS DISTINCT FROM strftime({parse_date('order_date')}, '%Y-%m-%d')", f"{DO} t"),
    "r5_number_decision": decided("fix_formats", "to_number", "amount", f"amount IS DISTINCT FROM CAST({money('amount')} AS VARCHAR)", f"{MO} t", "string -> double"),
    "r7_duplicate_decision": (f"SELECT 'fix_duplicates' AS step, 'drop_duplicates' AS op, NULL::VARCHAR AS column_name, "
                              f"(SELECT count(*) FROM {DP} t) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {DP} t)) AS changed, '' AS retyped"),
    "r8_near_duplicate_decision": (
        f"WITH RECURSIVE {lcs_scores(NP, 'p_name')}, np AS (SELECT *, {sort_key('p_name')} AS key FROM {NP} t), "
        f"hits AS (SELECT ka, kb FROM scores WHERE score >= 92 UNION ALL SELECT kb, ka FROM scores WHERE score >= 92 "
        f"UNION ALL SELECT key, key FROM keys WHERE key <> ''), "
        f"firsts AS (SELECT hits.kb AS key, min(e.p_partkey) AS first FROM np e JOIN hits ON hits.ka = e.key GROUP BY 1) "
        f"SELECT 'fix_duplicates' AS step, 'flag_near_duplicates' AS op, NULL::VARCHAR AS column_name, count(*) AS changed, '' AS retyped "
        f"FROM np JOIN firsts USING (key) WHERE first < p_partkey"),
    "r9_outlier_decision": decided("fix_broken_entries", "cap", "value", "value < lo OR value > hi", f"events, ({fences('events', 'value')}) q"),
    "x17_near_flags_any_earlier": (
        f"WITH RECURSIVE {lcs_scores(NP, 'p_name')}, np AS (SELECT *, {sort_key('p_name')} AS key, row_number() OVER (ORDER BY p_partkey) AS i FROM {NP} t), "
        f"hits AS (SELECT ka, kb FROM scores WHERE score >= 92 UNION ALL SELECT kb, ka FROM scores WHERE score >= 92 "
        f"UNION ALL SELECT key, key FROM keys WHERE key <> '') "
        f"SELECT p_partkey, p_name, EXISTS (SELECT 1 FROM np e JOIN hits ON hits.ka = e.key WHERE hits.kb = np.key "
        f"AND e.i < np.i AND e.i > np.i - 300) AS _near_duplicate FROM np"),
    "x17_near_flags_greedy": (
        f"WITH RECURSIVE {lcs_scores(NP, 'p_name')}, np AS (SELECT *, {sort_key('p_name')} AS key, row_number() OVER (ORDER BY p_partkey) AS i FROM {NP} t), "
        f"hits AS (SELECT ka, kb FROM scores WHERE score >= 92 UNION ALL SELECT kb, ka FROM scores WHERE score >= 92 "
        f"UNION ALL SELECT key, key FROM keys WHERE key <> ''), "
        f"like_before AS (SELECT l.i, list(e.i) AS who FROM np l JOIN hits ON hits.kb = l.key JOIN np e ON e.key = hits.ka "
        f"AND e.i < l.i AND e.i > l.i - 300 GROUP BY l.i), "
        f"rows_before AS (SELECT np.i, coalesce(who, []) AS who FROM np LEFT JOIN like_before USING (i)), "
        f"walk AS (SELECT 1::BIGINT AS i, FALSE AS flagged, [1::BIGINT] AS kept UNION ALL "
        f"SELECT b.i, list_has_any(b.who, w.kept), CASE WHEN list_has_any(b.who, w.kept) THEN w.kept "
        f"ELSE list_append(list_filter(w.kept, lambda x: x > b.i - 300), b.i) END FROM walk w JOIN rows_before b ON b.i = w.i + 1) "
        f"SELECT p_partkey, p_name, flagged AS _near_duplicate FROM np JOIN walk USING (i)"),
    # Distinct keys in row order; each is kept unless it is like one kept before.
    "x17_near_flags_greedy_table": (
        f"WITH RECURSIVE {lcs_scores(NP, 'p_name')}, np AS (SELECT *, {sort_key('p_name')} AS key FROM {NP} t), "
        f"hits AS (SELECT ka, kb FROM scores WHERE score >= 92 UNION SELECT kb, ka FROM scores WHERE score >= 92), "
        f"f AS (SELECT key, min(p_partkey) AS first, row_number() OVER (ORDER BY min(p_partkey)) AS i FROM np WHERE key <> '' GROUP BY key), "
        f"near AS (SELECT b.i, list(a.i) AS who FROM hits JOIN f a ON a.key = ka JOIN f b ON b.key = kb AND a.i < b.i GROUP BY b.i), "
        f"walk AS (SELECT 0::BIGINT AS i, [0::BIGINT] AS kept UNION ALL SELECT f.i, CASE WHEN list_has_any(coalesce(who, []), w.kept) THEN w.kept "
        f"ELSE list_append(w.kept, f.i) END FROM walk w JOIN f ON f.i = w.i + 1 LEFT JOIN near ON near.i = f.i), "
        f"k AS (SELECT unnest(kept) AS i FROM walk QUALIFY row_number() OVER (ORDER BY walk.i DESC) = 1) "
        f"SELECT p_partkey, p_name, coalesce(f.i IS NOT NULL AND (f.i NOT IN (SELECT i FROM k) OR f.first < p_partkey), FALSE) AS _near_duplicate "
        f"FROM np LEFT JOIN f USING (key)"),
    "x17_near_flags_whole_table": (
        f"WITH RECURSIVE {lcs_scores(NP, 'p_name')}, np AS (SELECT *, {sort_key('p_name')} AS key FROM {NP} t), "
        f"hits AS (SELECT ka, kb FROM scores WHERE score >= 92 UNION ALL SELECT kb, ka FROM scores WHERE score >= 92 "
        f"UNION ALL SELECT key, key FROM keys WHERE key <> ''), "
        f"firsts AS (SELECT hits.kb AS key, min(e.p_partkey) AS first FROM np e JOIN hits ON hits.ka = e.key GROUP BY 1) "
        f"SELECT p_partkey, p_name, coalesce(first < p_partkey, FALSE) AS _near_duplicate FROM np LEFT JOIN firsts USING (key)"),
    "x18_money": f"SELECT o_orderkey, order_date, o_orderpriority, {money('amount')} AS amount FROM {DO} t",
    "x19_canonical_spelling": (
        f"WITH s AS (SELECT lower(o_orderpriority) AS k, o_orderpriority AS v, count(*) AS n FROM {DO} t GROUP BY ALL), "
        f"b AS (SELECT k, v FROM s QUALIFY row_number() OVER (PARTITION BY k ORDER BY n DESC, v) = 1) "
        f"SELECT o_orderkey, order_date, amount, b.v AS o_orderpriority FROM {DO} t JOIN b ON b.k = lower(o_orderpriority)"),
    "x20_parse_dates": f"SELECT o_orderkey, amount, o_orderpriority, {parse_date('order_date')} AS order_date FROM {DO} t",
    "x22_recheck": (f"WITH x AS (SELECT {X1} FROM {DC} t) SELECT count(*) AS n_rows, "
                    f"CAST(sum({' + '.join(f'CAST({c} IS NULL AS BIGINT)' for c in DC_COLUMNS)}) AS BIGINT) AS missing_cells FROM x"),
    "v1_v3_validate": validated(),
    "v2_before_after": (
        f"WITH b AS (SELECT * FROM {DL} t), a AS (SELECT DISTINCT * FROM b), c AS (SELECT * EXCLUDE (l_tax) FROM a), "
        f"n AS (SELECT (SELECT count(*) FROM b) AS nb, (SELECT count(*) FROM a) AS na, "
        f"(SELECT count(*) FROM (SELECT DISTINCT * FROM c)) AS nd) "
        f"SELECT nb AS rows_before, na AS rows_after, nb - na AS rows_removed, 11::BIGINT AS columns_before, "
        f"10::BIGINT AS columns_after, 1::BIGINT AS columns_removed, 0::BIGINT AS missing_before, 0::BIGINT AS missing_after, "
        f"nb - na AS duplicates_before, na - nd AS duplicates_after, "
        f"round(na * 100.0::DOUBLE / nb, 2) AS pct_data_retained FROM n"),
    # The first pass, then the loop that fills what it nulled and caps what the fill left outside the fences.
    "v5_clean_full": (
        f"WITH {STAGES}, {stage('x6', 'x5', {c: null_out(c) for c in DC_TEXT})}, "
        f"a AS (SELECT count(*) FILTER (cust_age IS NULL) / count(*)::DOUBLE AS p, quantile_cont(cust_age, 0.5) AS med, avg(cust_age) AS mu FROM x6), "
        f"x7 AS (SELECT c_custkey, c_nationkey::BIGINT AS c_nationkey, c_acctbal, {', '.join(f'coalesce({c}, {mode("x6", c)}) AS {c}' for c in DC_TEXT)}, "
        f"coalesce(cust_age::DOUBLE, CASE WHEN p < 0.05 OR p >= 0.3 THEN med ELSE mu END) AS cust_age FROM x6, a) "
        f"SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment, contact_email, contact_phone, greatest(lo, least(hi, cust_age)) AS cust_age "
        f"FROM x7, ({fences('x7', 'cust_age')}) q"),
    "v6_v7_summary": (
        f"WITH b AS (SELECT o_orderkey FROM {DP} t) SELECT count(*) AS rows_before, count(DISTINCT o_orderkey) AS rows_after, "
        f"count(*) - count(DISTINCT o_orderkey) AS rows_removed, count(*) - count(DISTINCT o_orderkey) AS exact_duplicates, "
        f"CAST(floor(count(DISTINCT o_orderkey) * 100.0::DOUBLE / count(*) + 0.5) AS INT) AS quality_score FROM b"),
}
