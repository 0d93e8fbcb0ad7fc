"""Rules of one's own from detection to report, JSON value kinds, one-scan samples."""

from tablewright.config import Config, Rule
from tablewright.operators import formats, profile
from tablewright.operators.rows import ROW_ID
from tablewright.plans import cleaning

RULES = Config.recommended(rules=(
    Rule("negative_price", "{value} < 0", words=("price",), repair="abs({value})"),
    Rule("no_code", "NOT ({value} RLIKE '^[A-Z]{2}-[a-z]+$')", columns=("my `code`",)),
    Rule("odd_id", "{value} % 2 = 1", columns=("id",), repair=None)))


def test_a_rule_is_detected_decided_applied_and_reported(spark):
    rows = [(i, float(i if i % 3 else -i - 1), f"AB-{'xyz'[i % 3] * 3}" if i % 4 else "bad") for i in range(60)] + [(60, None, None)]
    df = spark.createDataFrame(rows, "id bigint, unit_price double, `my ``code``` string")
    result = cleaning.clean(df, RULES, order_by="id")
    out = {r["id"]: r for r in result.df.collect()}
    assert all(r[1] >= 0 for r in out.values() if r[1] is not None)
    assert out[0][1] == 1.0 and out[1][1] == 1.0
    found = {(a.column, a.params["rule"]): a.changed for a in result.plan.actions if a.op == "rule" and a.effective}
    assert found["unit_price", "negative_price"] == 20 and found["my `code`", "no_code"] == 15
    assert "negative_price" in result.report and "odd_id" in result.report
    # The plan holds for new rows too.
    again = result.plan.apply(spark.createDataFrame([(61, -5.0, "XY-q"), (63, 2.0, "zz")], df.schema))
    assert {r["unit_price"] for r in again.collect()} == {5.0, 2.0}
    assert {r.op for r in result.decisions.collect()} >= {"rule"}


def test_rules_say_nothing_about_missing_values(spark):
    df = spark.createDataFrame([(None,), (-1.0,), (float("nan"),)], "price double")
    config = Config(rules=(Rule("negative", "{value} < 0", words=("price",)),))
    from tablewright.operators.broken import broken_counts
    assert [(r.rule, r.n) for r in broken_counts(df, config).collect()] == [("negative", 1)]


def test_json_kinds(spark):
    texts = ['{"a": 1, "b": "x"}', '{"a": 2.5, "b": null}', '{"a": "t"}', '{"a": {"c": 1}}', '{"a": [1]}', '{"a": false}', "no json", "[1]", None, ""]
    got = {(r.key, r.kind): r.n for r in formats.json_types(spark.createDataFrame([(t,) for t in texts], "payload string")).collect()}
    assert got == {("a", "number"): 2, ("a", "text"): 1, ("a", "object"): 1, ("a", "array"): 1, ("a", "boolean"): 1, ("b", "text"): 1, ("b", "null"): 1}


def test_samples_of_many_columns_need_one_scan(spark):
    df = spark.createDataFrame([(i, *[None if (i + c) % 3 == 0 else i * c for c in range(30)]) for i in range(50)], f"{ROW_ID} bigint, " + ", ".join(f"c{c} int" for c in range(30)))
    samples = profile.sample_values(df, 4)
    got = {}
    for r in samples.collect():
        got.setdefault(r.column_name, []).append((r[ROW_ID], r.value))
    for c in range(30):
        assert sorted(got[f"c{c}"]) == [(i, str(i * c)) for i in range(50) if (i + c) % 3][:4]
    assert samples._jdf.queryExecution().executedPlan().toString().count("Scan ExistingRDD") <= 2     # the plan at first and at last
