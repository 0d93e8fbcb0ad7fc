import csv
import json
import random

import pytest
from pyspark.sql import functions as F

from tablewright.plans.run import analyze_directory, clean_directory
from tablewright.sources import files, sinks


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "deep" / "er").mkdir(parents=True)
    (tmp_path / "a.csv").write_text('id,name,v\n1,"two\nlines",1.5\n2,x,NA\n3,y,2.5,surplus\n4,short\n')
    (tmp_path / "deep" / "b.CSV").write_text("id,other\n7,True\n8,False\n")
    (tmp_path / "deep" / "er" / "c.txt").write_text("k;w\n1;a\n2;b\n")
    (tmp_path / "deep" / "d.txt").write_text("k\tw\n3\tc\n")
    (tmp_path / "e.json").write_text(json.dumps([{"z": 1, "a": "5", "created_at": "2024-01-02"},
                                                 {"z": 2, "a": "6", "created_at": "2024-02-03"}]))
    (tmp_path / "f.json").write_text('{"z": 3, "b": "t"}\n{"z": 4, "b": "u"}\n')
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "bad.json").write_text("not json")
    return str(tmp_path)


def by_columns(loaded):
    return {tuple(df.columns): df for df in loaded.frames()}


def test_load_directory(spark, folder):
    loaded = files.load_directory(spark, folder)
    tables = by_columns(loaded)
    assert set(tables) == {("id", "name", "v"), ("id", "other"), ("k", "w"), ("z", "a", "created_at"), ("z", "b")}
    a = {r.id: r for r in tables["id", "name", "v"].collect()}
    assert a[1].name == "two\nlines" and a[2].v is None and a[4].name == "short" and 3 not in a
    assert dict(tables["id", "other"].dtypes) == {"id": "bigint", "other": "boolean"}
    assert sum(df.count() for c, df in ((tuple(d.columns), d) for d in loaded.frames()) if c == ("k", "w")) == 3
    j = tables["z", "a", "created_at"]
    assert dict(j.dtypes) == {"z": "bigint", "a": "bigint", "created_at": "timestamp_ntz"}
    assert {p.rsplit("/", 1)[1] for p, _ in loaded.failures} == {"bad.json"}
    rejected = loaded.quarantine().collect()
    assert [r.record for r in rejected] == ["3,y,2.5,surplus"] and rejected[0].path.endswith("a.csv")
    assert loaded.n_files == 6
    # Columns pruned later must not bring surplus lines back.
    assert tables["id", "name", "v"].select("id").count() == 3


def test_combine_aligns_types(spark):
    one = spark.createDataFrame([(1, 2)], "a int, b bigint")
    two = spark.createDataFrame([(1.5, "x", "y")], "a double, b string, c string")
    out = files.combine([one, two])
    assert out.columns == ["a", "b", "c"]
    assert {tuple(r) for r in out.collect()} == {(1.0, "2", None), (1.5, "x", "y")}
    with pytest.raises(ValueError):
        files.combine([])


def test_headers_and_separators():
    assert files.header_names("a,,a\n1,2,3", ",") == ["a", "Unnamed: 1", "a.1"]
    assert files.sniff_separator("a|b|c\n1|2|3") == "|" and files.sniff_separator("a\tb") == "\t"


def test_epoch_date_keys(spark):
    df = spark.createDataFrame([(1_700_000_000, 5, "x")], "seen_at bigint, created_at bigint, modified string")
    out = files.parse_date_keys(df)
    assert dict(out.dtypes) == {"seen_at": "timestamp_ntz", "created_at": "bigint", "modified": "string"}
    assert str(out.first().seen_at) == "2023-11-14 22:13:20"


def test_directory_runs(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("id, The City;(x)\n1,paris\n2,PARIS\n2,PARIS\n")
    (tmp_path / "in" / "b.csv").write_text("id, The City;(x)\n3,Rome\n4,\n")
    result = clean_directory(spark, str(tmp_path / "in"), str(tmp_path / "out"), file_types=["csv"])
    assert result.summary()["input"] == {"files": 2, "unreadable_files": 0, "rejected_lines": 0} and result.df.count() == 4
    assert (tmp_path / "out" / "narrative").exists()
    issues, report = analyze_directory(spark, str(tmp_path / "in"))
    assert issues.exact_duplicates == 1 and "## Missing values" in report
    with pytest.raises(ValueError):
        clean_directory(spark, str(tmp_path / "in"), file_types=["json"])


def test_losses_are_reported(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("id,v\n1,x\n2,y,surplus\n3,z\n")
    (tmp_path / "in" / "blank.csv").write_text("\n\n")
    result = clean_directory(spark, str(tmp_path / "in"), str(tmp_path / "out"), file_types=["csv"])
    assert result.summary()["input"] == {"files": 1, "unreadable_files": 1, "rejected_lines": 1}
    assert result.source.count() == 2
    assert [r.record for r in spark.read.json(str(tmp_path / "out" / "rejected_lines")).collect()] == ["2,y,surplus"]
    assert spark.read.json(str(tmp_path / "out" / "unreadable_files")).count() == 1
    assert "could not be read" in result.narrative
    assert "rejected lines: 1" in analyze_directory(spark, str(tmp_path / "in"), file_types=["csv"])[1]


def test_header_longer_than_a_read(spark, tmp_path):
    names = [f"column_{'x' * 400}_{i}" for i in range(300)]
    (tmp_path / "wide.csv").write_text(",".join(names) + "\n" + "\n".join(",".join([str(r)] * 300) for r in range(3)) + "\n")
    df, = files.load_directory(spark, str(tmp_path), ["csv"], infer=False).frames()
    assert len(df.columns) == 300 and df.count() == 3


def test_json_with_a_long_first_line(spark, tmp_path):
    rows = [{"a": "x" * 100_000, "b": 1}] + [{"a": "y", "b": i} for i in range(99)]
    (tmp_path / "long.json").write_text("\n".join(map(json.dumps, rows)))
    df, = files.load_directory(spark, str(tmp_path), ["json"]).frames()
    assert df.count() == 100


def test_json_by_columns(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"a": {"0": 1, "1": 2, "2": 3}, "b": {"0": "x", "1": None, "2": "z"}}))
    (tmp_path / "one.json").write_text(json.dumps({"a": {"k": 1}, "b": 5}))
    (tmp_path / "bad.json").write_text('{"a": 1,')
    loaded = files.load_directory(spark, str(tmp_path), ["json"])
    tables = {df.count(): df for df in loaded.frames()}
    assert sorted((r.a, r.b) for r in tables[3].collect()) == [(1, "x"), (2, None), (3, "z")]
    assert dict(tables[3].dtypes)["a"] == "bigint" and 1 in tables
    assert [p.rsplit("/", 1)[1] for p, _ in loaded.failures] == ["bad.json"]


def test_long_whole_numbers_keep_their_digits(spark):
    df = spark.createDataFrame([("9007199254740993123", "9" * 25, "1" * 50, "1"), ("9007199254740993124", "5", "2", "2.5")],
                               "a string, b string, c string, d string")
    out = files.infer_types(df)
    assert dict(out.dtypes) == {"a": "bigint", "b": "decimal(38,0)", "c": "string", "d": "double"}
    assert out.select("a").distinct().count() == 2
    big = spark.createDataFrame([(2 ** 53 + 1,)], "a bigint")
    both = files.combine([big, spark.createDataFrame([(0.5,)], "a double")])
    assert sorted(r.a for r in both.collect()) == ["0.5", str(2 ** 53 + 1)]


def test_files_split_unless_quotes_span_lines(spark, tmp_path):
    (tmp_path / "plain.csv").write_text("a,b\n" + "".join(f"{i},text {i}\n" for i in range(60_000)))
    (tmp_path / "quoted.csv").write_text('a,b\n1,"x\ny"\n')
    paths = [p for p, _ in files.list_files(spark, str(tmp_path), "csv")]
    assert {p.rsplit("/", 1)[1] for p in files.with_quoted_breaks(spark, paths)} == {"quoted.csv"}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "128k")
    try:
        rows, _ = files.read_delimited(spark, paths, ["a", "b"])
        assert rows.count() == 60_001 and rows.rdd.getNumPartitions() > 4
        assert rows.filter("b = 'x\ny'").count() == 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.fixture
def small_blocks(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
    spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def test_quoted_breaks_split_like_a_csv_reader(spark, tmp_path, small_blocks):
    rng = random.Random(4)
    values = ["plain", 'with "quotes"', "two\nlines", "comma, inside", 'a 5" pipe', "", "\n\n", '"', "x\r\ny", "é\n" * 40, "long " * 900 + "\n" + "tail " * 700, '",\n"']
    rows = [(str(i), rng.choice(values), rng.choice(values)) for i in range(400)]
    with open(tmp_path / "a.csv", "w", newline="") as f:
        w = csv.writer(f, lineterminator="\n")
        w.writerow(["id", "first value", "b"])
        w.writerows(rows)
        f.write("900,a 5\" pipe,not quoted\n901,surplus,b,c\n\n902,short\n")
    paths = [p for p, _ in files.list_files(spark, str(tmp_path), "csv")]
    records = files.splits.cut_records(spark, paths, "\n", files.splits.csv_scan(","))
    assert files.splits.pieces(spark, paths, "\n").rdd.getNumPartitions() > 20
    kept, rejected = files.read_delimited(spark, paths, ["id", "first value", "b"])
    want = [(a, b or None, c or None) for a, b, c in rows] + [("900", 'a 5" pipe', "not quoted"), ("902", "short", None)]
    assert sorted(map(str, map(tuple, kept.collect()))) == sorted(map(str, want))
    assert [r.record for r in rejected.collect()] == ["901,surplus,b,c"]
    assert records.where("not whole").count() == 0
    # As many records as Spark's reader of whole files finds.
    whole = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(paths)
    assert kept.count() + 1 == whole.count()


def test_a_quote_that_never_closes_loses_no_line(spark, tmp_path, small_blocks):
    (tmp_path / "a.csv").write_text('a,b\n1,"x\ny"\n2,"never closed\n' + "".join(f"{i},plain text {i}\n" for i in range(3, 2000)))
    kept, _ = files.read_delimited(spark, [p for p, _ in files.list_files(spark, str(tmp_path), "csv")], ["a", "b"], multi_line=True)
    rows = {r.a: r.b for r in kept.collect()}
    assert rows["1"] == "x\ny" and rows["1999"] == "plain text 1999" and len(rows) == 1999


def test_a_stray_quote_in_the_header_reads_little(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,"b\n' + "1,2\n" * 600_000)
    read = []
    for text, ended in files.starts(spark, str(tmp_path / "a.csv")):
        read.append(len(text))
        if files.first_line(text, ended) is not None:
            break
    assert max(read) <= 2 * files.READ_LIMIT + files.READ_STEP
    assert files.read_start(spark, str(tmp_path / "a.csv")) == 'a,"b'


@pytest.mark.parametrize("indent", [None, 1])
def test_json_arrays_split(spark, tmp_path, small_blocks, indent):
    rng = random.Random(6)
    texts = ["plain", 'quote " and } brace', "back\\slash\\", "{[", "}" * 30, "é" * 200, "x, y", "", None]
    rows = [{"id": i, "t": rng.choice(texts), "deep": {"k": {"v": rng.choice(texts), "n": [1, {"z": i}]}}} for i in range(300)]
    (tmp_path / "a.json").write_text(json.dumps(rows, indent=indent))
    (tmp_path / "b.json").write_text(json.dumps(rows[:2], indent=indent)[:-5])
    loaded = files.load_directory(spark, str(tmp_path), ["json"])
    df, = loaded.frames()
    got = {(r.id, r.t, r.deep.k.v, r.deep.k.n[1]) for r in df.collect()}
    plain = lambda n: json.dumps(n, separators=(",", ":"))
    assert {(i, t, v, n.replace(" ", "")) for i, t, v, n in got} == {(r["id"], r["t"], r["deep"]["k"]["v"], plain(r["deep"]["k"]["n"][1])) for r in rows}
    assert df.count() == 301 and loaded.quarantine().count() == 1


@pytest.mark.parametrize("indent", [None, 1])
def test_json_columns_split(spark, tmp_path, small_blocks, indent):
    rng = random.Random(7)
    texts = ["plain", 'quote " and } brace', "a, b", "{", "[,", "\\", "é" * 50, "", None]
    table = {"a b": {str(i): i for i in range(500)}, "c": {str(i): rng.choice(texts) for i in range(500)}, "d}": {str(i): None if i % 7 else i / 2 for i in range(500)}}
    (tmp_path / "a.json").write_text(json.dumps(table, indent=indent))
    df, = files.load_directory(spark, str(tmp_path), ["json"]).frames()
    assert df.columns == ["a b", "c", "d}"] and dict(df.dtypes)["a b"] == "bigint"
    assert {tuple(r) for r in df.collect()} == {(i, table["c"][str(i)], table["d}"][str(i)]) for i in range(500)}


def test_json_columns_are_written_cell_by_cell(spark, tmp_path):
    """A task holds neither its rows nor a line that grows with them."""
    rows = [(i, None if i % 5 == 0 else f'"é}}, {{{i}\n', i / 4) for i in range(6000)]
    sinks.write_json_columns(spark.createDataFrame(rows, "`a b` bigint, c string, `d\"}` double").coalesce(1), str(tmp_path / "out"))
    path, = (tmp_path / "out").glob("*.json")
    table = json.loads(path.read_text())
    assert list(table) == ["a b", "c", 'd"}'] and [list(t) for t in table.values()] == [[str(i) for i in range(6000)]] * 3
    assert list(zip(*[t.values() for t in table.values()])) == rows
    assert max(map(len, path.read_text().splitlines())) < 10_000
    df, = files.load_directory(spark, str(tmp_path / "out"), ["json"]).frames()
    assert sorted(map(tuple, df.collect())) == rows


def test_cells_of_one_json_file_meet_in_many_tasks(spark, tmp_path, small_blocks):
    table = {"a": {str(i): i for i in range(500)}, "b": {str(i): f"x{i}" for i in range(500)}}
    (tmp_path / "a.json").write_text(json.dumps(table))
    changed = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in changed}
    try:
        for k, v in changed.items():
            spark.conf.set(k, v)
        rows = files.read_json_columns(spark, [str(tmp_path / "a.json")]).withColumn("task", F.spark_partition_id()).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted((int(r.a), r.b) for r in rows) == [(i, f"x{i}") for i in range(500)]
    assert len({r.task for r in rows}) > 1


def test_layout_of_long_json_is_judged_by_its_start():
    big = '{"a":{"0":' + "1" * (2 * files.READ_LIMIT)
    assert files.json_layout(iter([(big[:files.READ_STEP], False), (big, False)])) == ("columns", [])
    assert files.json_layout(iter([('{"a":"' + "x" * files.READ_LIMIT, False)])) == ("lines", [])
    assert files.json_layout(iter([('[{"a":"' + "x" * files.READ_LIMIT, False)])) == ("array", [])
