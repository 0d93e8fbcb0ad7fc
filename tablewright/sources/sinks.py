"""Write a cleaned table and the documents that go with it."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..plans.cleaning import CleanResult
from ..plans.decisions import Issues
from ..session import ship_with_tasks


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with header, one part per task; nested columns as JSON text."""
    flat = df.select(*[F.to_json(f.name).alias(f.name)
                       if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) else F.col(f"`{f.name}`")
                       for f in df.schema.fields])
    # The writer would otherwise trim values.
    (flat.write.mode(mode).option("header", True).option("escape", '"').option("quote", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


def _framed(lines: DataFrame, before: str, between: str, after: str) -> DataFrame:
    """Lines with something before the first and after the last of each task, and at the end of all others."""
    def run(batches):
        held, started = None, False
        for batch in batches:
            out = []
            for text in batch.column(0).to_pylist():
                if held is not None:
                    out.append(held + between)
                held = text if started else before + text
                started = True
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([held + after], pa.string())], ["value"])

    return lines.mapInArrow(run, "value string")


def _text_as_json(lines: DataFrame, path: str, mode: str) -> None:
    """Write lines as they are, in files named as JSON: Spark's text writer has one ending only."""
    lines.write.mode(mode).text(path)
    spark = lines.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in system.listStatus(folder):
        name = status.getPath().getName()
        if name.endswith(".txt"):
            system.rename(status.getPath(), spark._jvm.org.apache.hadoop.fs.Path(folder, name[:-4] + ".json"))


def write_json_array(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON array of objects for each task."""
    lines = df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
    _text_as_json(_framed(lines, "[", ",", "]"), path, mode)


def write_json_columns(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object for each task that maps every column to {row label: value}, a few hundred cells in a line.

    The lines are sorted by column within their task, where Spark's sort goes to disk as needed; no task holds its rows at once.
    """
    names, in_line = df.columns, 256

    def cells(batches):
        begin = 0
        for batch in batches:
            for at in range(0, batch.num_rows, in_line):
                rows = [json.loads(text).values() for text in batch.column(0).slice(at, in_line).to_pylist()]
                lines = [",".join(f'"{i}":{json.dumps(v)}' for i, v in enumerate(own, begin)) for own in zip(*rows)]
                yield pa.RecordBatch.from_arrays([pa.array(range(len(lines)), pa.int32()), pa.array([begin] * len(lines), pa.int64()), pa.array(lines, pa.string())],
                                                 ["nth", "begin", "line"])
                begin += len(rows)

    def framed(batches):
        held, last = None, -1
        for batch in batches:
            for nth, line in zip(batch.column(0).to_pylist(), batch.column(2)):
                if held is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([held + ("," if nth == last else "},")], pa.string())], ["value"])
                opened = "" if nth == last else ("{" if last < 0 else "") + json.dumps(names[nth]) + ":{"
                held, last = opened + line.as_py(), nth
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([held + "}}"], pa.string())], ["value"])

    lines = df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
    placed = lines.mapInArrow(cells, "nth int, begin bigint, line string").sortWithinPartitions("nth", "begin")
    _text_as_json(placed.mapInArrow(framed, "value string"), path, mode)


def write_delimited_text(df: DataFrame, path: str, separator: str = "\t", mode: str = "overwrite") -> None:
    """Text files with a header line and values between separators."""
    lines = df.select(F.to_csv(F.struct("*"), {"sep": separator, "escape": '"'}).alias("value"))
    _framed(lines, separator.join(df.columns) + "\n", "", "").write.mode(mode).text(path)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def write_text(spark: SparkSession, text: str, path: str, mode: str = "overwrite") -> None:
    """A short document as text, on whatever file system the path names."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode(mode).text(path)


def write_log(spark: SparkSession, entries: list[dict], path: str, mode: str = "overwrite") -> None:
    """Log entries as JSON lines; nested details stay JSON text."""
    rows = [(i, e.get("step"), e.get("message"), e.get("timestamp"), json.dumps(e, default=str))
            for i, e in enumerate(entries)]
    (spark.createDataFrame(rows, "position int, step string, message string, timestamp string, entry string")
     .coalesce(1).write.mode(mode).json(path))


def issues_frame(spark: SparkSession, issues: Issues) -> DataFrame:
    """(kind, key, count, detail) rows of an issue summary."""
    rows = [("missing", c, m["n_missing"], json.dumps(m)) for c, m in issues.missing.items()]
    rows += [("format", k, len(v.split(", ")), v) for k, v in issues.formats.items()]
    rows += [("broken", k, b["count"], json.dumps(b)) for k, b in issues.broken.items()]
    rows += [("exact_duplicates", "rows", issues.exact_duplicates, json.dumps(issues.duplicate_rows))]
    rows += [("near_duplicates", "pairs", issues.near_pairs, json.dumps(issues.near_pairs_shown))]
    rows += [("contradictory", k, v["n_categories"], json.dumps(v)) for k, v in issues.contradictory.items()]
    rows += [("outliers", c, o["n_iqr"], json.dumps(o)) for c, o in issues.outliers.items()]
    return spark.createDataFrame(rows, "kind string, key string, count bigint, detail string")


def save(result: CleanResult, directory: str, formats=("csv",), mode: str = "overwrite") -> dict[str, str]:
    """Write table, reports, log and summary below a directory; returns paths."""
    spark = result.df.sparkSession
    base = directory.rstrip("/")
    out = {}
    for f in formats:
        out[f] = f"{base}/cleaned_data_{f}"
        (write_csv if f == "csv" else write_parquet)(result.df, out[f], mode)
    out["report"] = f"{base}/analysis_report"
    write_text(spark, result.report, out["report"], mode)
    out["narrative"] = f"{base}/narrative"
    write_text(spark, result.narrative, out["narrative"], mode)
    out["log"] = f"{base}/cleaning_log"
    write_log(spark, result.log, out["log"], mode)
    out["decisions"] = f"{base}/decisions"
    result.decisions.coalesce(1).write.mode(mode).json(out["decisions"])
    out["near_pairs"] = f"{base}/near_pairs"
    write_parquet(result.issues.near_pairs_table, out["near_pairs"], mode)
    out["failures"] = f"{base}/unreadable_files"
    spark.createDataFrame(result.failures, "path string, error string").coalesce(1).write.mode(mode).json(out["failures"])
    if result.rejected is not None:
        out["rejected"] = f"{base}/rejected_lines"
        result.rejected.write.mode(mode).json(out["rejected"])
    out["summary"] = f"{base}/analysis_summary"
    issues_frame(spark, result.issues).coalesce(1).write.mode(mode).json(out["summary"])
    return out


ship_with_tasks(__name__)
