import datetime as dt

from pyspark.sql import functions as F

from tablewright import Config
from tablewright.operators import repairs
from tablewright.operators.repairs import apply_actions, clip, snake_case_names
from tablewright.plans import cleaning, fitting
from tablewright.plans.decisions import decisions_frame, identify


def share(k, n=100):
    """A column of n values of which the first k are missing."""
    return [None if i < k else float(i) for i in range(n)]


def test_imputation_thresholds(spark):
    cols = {"p04": 4, "p05": 5, "p29": 29, "p30": 30, "p60": 60, "p61": 61}
    data = list(zip(*[share(k) for k in cols.values()]))
    df = spark.createDataFrame(data, ", ".join(f"{c} double" for c in cols))
    how = {a.column: a.params.get("how", a.op) for a in fitting.fit_missing(df) if a.op != "null_placeholders"}
    assert how == {"p04": "median", "p05": "mean", "p29": "mean", "p30": "median", "p60": "median", "p61": "drop_column"}
    out = cleaning.fix_missing(df)
    assert out.columns == ["p04", "p05", "p29", "p30", "p60"]
    first = out.filter("p60 = 79.5").first()
    assert (first.p04, first.p05, first.p29, first.p30) == (51.5, 52.0, 64.0, 64.5)


def test_dates_take_the_upper_median(spark):
    days = [dt.datetime(2024, 1, d) for d in (1, 2, 3, 10)]
    df = spark.createDataFrame([(d,) for d in days + [None]], "created_at timestamp_ntz")
    out = [r[0] for r in cleaning.fix_missing(df).collect()]
    assert sorted(out) == sorted(days + [days[2]])


def test_mode_ties_and_unknown(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), ("-",)], "m string")
    assert sorted(r.m for r in cleaning.fix_missing(df).collect()) == ["a", "a", "a", "b", "b"]


def test_clip_keeps_null(spark):
    df = spark.createDataFrame([(None,), (1,), (50,)], "v int")
    assert [r[0] for r in df.select(clip(F.col("v"), 2.0, 10.0)).collect()] == [None, 2.0, 10.0]


def test_snake_case_collisions():
    assert snake_case_names(["A b", "a-b", " a.b ", "A  b", "c"]) == {
        "A b": "a_b", "a-b": "a_b_2", " a.b ": "a_b_3", "A  b": "a_b_4", "c": "c"}


def test_formats_and_domains(spark):
    df = spark.createDataFrame([("$1,000", "01/31/2020", 130), ("2000", "2020-02-28", 30), ("x", "2020-03-01", -1),
                                ("4.5", "later", 120)], "price string, due_date string, age int").coalesce(1)
    out = cleaning.fix_formats(df).collect()
    assert [r.price for r in out] == [1000.0, 2000.0, None, 4.5]
    assert [r.due_date for r in out] == ["2020-01-31", "2020-02-28", "2020-03-01", None]
    aged = apply_actions(df, fitting.fit_domains(df)).collect()
    assert [r.age for r in aged] == [None, 30, None, 120]
    texts = repairs.nullify_ages(spark.createDataFrame([("30",), ("x",), ("121",)], "age string").coalesce(1))
    assert [r.age for r in texts.collect()] == [30.0, None, None]


def test_integral_cast(spark):
    df = spark.createDataFrame([(1.0, 1.5, 2.0 ** 60, None), (2.0, 2.0, 1.0, None)], "a double, b double, c double, d double")
    assert {a.column for a in fitting.fit_integral(df)} == {"a", "c"}


def test_repairs_are_idempotent(messy):
    for fix in (repairs.null_placeholders, cleaning.fix_text_consistency):
        once = fix(messy)
        assert sorted(map(str, once.collect())) == sorted(map(str, fix(once).collect()))


def test_decisions_are_the_measured_repairs(spark, messy):
    issues = identify(messy, as_of="2024-01-01")
    assert issues.total == sum(issues.counts().values())
    actions = cleaning.decide(messy, order_by="id")
    done = {(a.op, a.column): a for a in actions if a.effective}
    assert done["fill", "salary"].params["how"] == "mode" and done["fill", "salary"].changed == 3
    assert done["null_placeholders", "salary"].changed == 3 and done["drop_duplicates", None].changed == 1
    assert done["to_number", "salary"].retyped == "string -> double"
    assert done["null_email", "email"].changed == 3 and done["title", "department"].changed > 0
    # A repair without effect is no decision.
    assert ("null_placeholders", "email") not in done and ("null_placeholders", "email") in {(a.op, a.column) for a in actions}
    rows = decisions_frame(spark, actions).collect()
    assert [(r.op, r.column_name, r.changed) for r in rows] == [(a.op, a.column, a.changed) for a in actions if a.effective]


def test_decisions_equal_a_comparison_of_tables(spark, messy):
    from tablewright.operators.repairs import measured
    from tablewright.operators.rows import with_row_id

    df = with_row_id(messy.dropDuplicates(["id"]), "id")
    for step in ("fix_missing", "fix_text_consistency"):
        actions = measured(df, cleaning.STEPS[step](df))
        before = {r.id: r for r in df.collect()}
        after = {r.id: r for r in apply_actions(df, actions).collect()}
        for column in df.columns[:-1]:
            cells = sum(before[i][column] != after[i][column] for i in before)
            # A placeholder that is filled afterwards is two changes of one cell.
            most = sum(a.changed for a in actions if a.column == column)
            assert cells <= most and (most == 0) == (cells == 0)


def test_full_workflow_plan_and_stream(spark, messy, tmp_path):
    from tablewright.sources.sinks import save
    from tablewright.streaming import clean_stream

    result = cleaning.clean(messy, order_by="id", as_of="2024-01-01")
    rows = {r.id: r for r in result.df.collect()}
    summary = result.summary()
    assert len(rows) == 10 and summary["rows"] == {"before": 11, "after": 10} and summary["changed_by_repair"]["drop_duplicates"] == 1
    assert summary["near_pairs"] == result.issues.near_pairs_table.count()
    assert rows[2].name == "Bea Stone" and rows[2].date_of_birth == "1987-03-25"
    assert rows[1].salary == 41000 and rows[7].department == "Design"
    assert all(v is not None for r in rows.values() for v in r)
    assert "## By column" in result.narrative and result.validation.missing == {}
    assert result.decisions.count() == sum(a.effective for a in result.plan.actions)

    paths = save(result, str(tmp_path / "out"), formats=("csv", "parquet"))
    assert spark.read.option("header", True).csv(paths["csv"]).count() == 10
    assert spark.read.json(paths["summary"]).filter("kind = 'exact_duplicates'").first()["count"] == 1
    assert spark.read.text(paths["report"]).count() > 5 and spark.read.json(paths["log"]).count() > 5
    assert spark.read.json(paths["decisions"]).count() == result.decisions.count()
    assert spark.read.parquet(paths["near_pairs"]).count() == summary["near_pairs"]

    messy.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(messy.schema).parquet(str(tmp_path / "in"))
    query = (clean_stream(stream, result.plan).writeStream.format("memory").queryName("cleaned")
             .trigger(availableNow=True).start())
    query.awaitTermination(60)
    out = {r.id: r for r in spark.table("cleaned").collect()}
    assert spark.table("cleaned").count() == 11 and out[2].name == "Bea Stone"


def test_recommended_order_leaves_keys_alone(messy):
    result = cleaning.clean(messy, Config.recommended(), as_of="2024-01-01")
    rows = {r.id: r for r in result.df.collect()}
    assert rows[4].email is None and rows[4].name is None
    assert result.validation.broken == {}
