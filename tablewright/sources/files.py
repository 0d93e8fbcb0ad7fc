"""Load messy files of several layouts into typed or text tables.

Only file names, sizes and the first record of each file are looked at on the
driver; the data is read by Spark, one scan per distinct header, and every
file splits into tasks.
"""

from __future__ import annotations

import csv
import io
import json
import re
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions import as_text, parse_date, parse_number, strip
from ..operators.rows import ROW_ID, aggregate_row, col, field_types
from ..session import write_table
from . import splits

# Tokens that a CSV reader turns into missing values at load.
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
             "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
             "n/a", "nan", "null")

CORRUPT = "_corrupt_record"
WHOLE = r"^[+-]?\d+$"
READ_STEP = 64 * 1024
#: Most bytes of a file that its layout is judged by, but for a first line longer than that.
READ_LIMIT = 1024 * 1024
FILE_TYPES = ("csv", "json", "txt")


@dataclass
class LoadedTables:
    """One DataFrame per group of files with the same header."""

    tables: list[tuple[list[str], DataFrame]] = field(default_factory=list)
    rejected: list[DataFrame] = field(default_factory=list)
    failures: list[tuple[str, str]] = field(default_factory=list)

    @property
    def n_files(self) -> int:
        return sum(len(paths) for paths, _ in self.tables)

    def frames(self) -> list[DataFrame]:
        return [df for _, df in self.tables]

    def quarantine(self) -> DataFrame | None:
        """(path, record) of lines with too many fields."""
        out = None
        for r in self.rejected:
            out = r if out is None else out.unionByName(r)
        return out


def list_files(spark: SparkSession, directory: str, extension: str) -> list[tuple[str, int]]:
    """(path, bytes) of all files with the extension, any case of it, any depth.

    The content column is not selected, so nothing is read but the listing.
    """
    either = "".join(f"[{ch.lower()}{ch.upper()}]" for ch in extension)
    listing = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
               .option("pathGlobFilter", f"*.{either}").load(directory).select("path", "length"))
    return sorted((r["path"], r["length"]) for r in listing.collect())


def starts(spark: SparkSession, path: str, step: int = READ_STEP) -> Iterator[tuple[str, bool]]:
    """Ever longer starts of a file as text, through the Hadoop file system,
    and whether the file ends there.  Each start is twice as long as the last.
    """
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = jpath.getFileSystem(spark._jsc.hadoopConfiguration()).open(jpath)
    data, want = b"", step
    try:
        while True:
            more = bytes(stream.readNBytes(want))
            data += more
            yield data.decode("utf-8", errors="ignore").removeprefix("\ufeff"), len(more) < want
            if len(more) < want:
                return
            want = len(data)
    finally:
        stream.close()


def first_line(text: str, ended: bool = True, separator: str | None = None) -> str | None:
    """The first record of delimited text that isn't blank, with quoted line
    breaks; None if it may go on beyond the text.

    A quote opens a value only at its beginning, behind any separator unless
    one is given.  One that isn't closed within ``READ_LIMIT`` is no quote.
    """
    at = len(text) - len(text.lstrip("\r\n"))
    if not text[at:]:
        return "" if ended else None
    lines, taken = text[at:].split("\n"), []
    scans = [splits.csv_scan(s) for s in (separator or ",;|\t")]
    states = [False] * len(scans)
    for i, line in enumerate(lines):
        if i == len(lines) - 1 and not ended:
            break
        states = [scan(line, state)[0] for scan, state in zip(scans, states)]
        taken.append(line)
        if not all(states):
            record = "\n".join(taken).rstrip("\r")
            if record.strip():
                return record
            taken, states = [], [False] * len(scans)
    if not ended and (len(text) <= READ_LIMIT or not taken):
        return None
    return lines[0].rstrip("\r")


def read_start(spark: SparkSession, path: str) -> str:
    """The first record of a delimited file: its first line, or up to ``READ_LIMIT`` where quoted breaks follow."""
    for text, ended in starts(spark, path):
        record = first_line(text, ended)
        if record is not None:
            return record
    return ""


def sniff_separator(text: str) -> str:
    """Separator of delimited text, judged by its first record."""
    line = first_line(text) or ""
    counts = {s: line.count(s) for s in ("\t", ";", "|", ",")}
    best = max(counts, key=counts.get)
    if counts[best]:
        return best
    try:
        return csv.Sniffer().sniff(line).delimiter
    except csv.Error:
        return ","


def header_names(text: str, separator: str) -> list[str]:
    """Column names of the first record; blanks are numbered, repeats suffixed."""
    names = next((r for r in csv.reader(io.StringIO(text), delimiter=separator) if r), [])
    out, used = [], set()
    for i, name in enumerate(names):
        base = name if name.strip() else f"Unnamed: {i}"
        unique, k = base, 1
        while unique in used:
            unique, k = f"{base}.{k}", k + 1
        used.add(unique)
        out.append(unique)
    return out


def _touch(c, dtype: T.DataType = T.StringType()):
    """Always true, but reads the column: Spark refuses queries that touch
    nothing but the corrupt-record column, as a plain count would."""
    if isinstance(dtype, T.StringType):
        return F.coalesce(F.length(c), F.lit(0)) >= 0
    return F.coalesce(F.length(F.to_json(F.struct(c.alias("x")))), F.lit(0)) >= 0


def _plain(path: str) -> str:
    """One spelling of a path, whichever part of Spark spelled it."""
    return re.sub(r"^([a-z0-9]+):/+", r"\1:/", path)


def with_quoted_breaks(spark: SparkSession, paths: Sequence[str]) -> set[str]:
    """The files in which some line holds an odd number of quotes: a quoted
    value goes on in the next line.  One splittable scan, one row per file.
    """
    text = spark.read.text(list(paths))
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    found = (text.select(F.col("_metadata.file_path").alias("path"), (quotes % 2 == 1).alias("odd"))
             .groupBy("path").agg(F.max("odd").alias("odd")).filter("odd"))
    odd = {_plain(unquote(r["path"])) for r in found.collect()}
    return {p for p in paths if _plain(p) in odd}


def read_delimited(spark: SparkSession, paths: Sequence[str], names: Sequence[str], separator: str = ",",
                   multi_line: bool | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows as text, rejected lines) of files that share a header.

    Lines with too few fields are padded with NULL, lines with too many are
    rejected.  Spark splits files into tasks; where a scan finds that quoted
    values hold line breaks, records are cut by their quotes, in as many tasks.
    True or False for ``multi_line`` skips that scan.
    """
    if multi_line is None:
        whole = with_quoted_breaks(spark, paths)
        if whole and len(whole) < len(paths):
            parts = [read_delimited(spark, [p for p in paths if (p in whole) == m], names, separator, m) for m in (True, False)]
            return parts[0][0].unionAll(parts[1][0]), parts[0][1].unionAll(parts[1][1])
        multi_line = bool(whole)
    if multi_line:
        return _read_quoted(spark, paths, names, separator)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names]
                          + [T.StructField(CORRUPT, T.StringType())])
    # Pruned columns would hide surplus fields from the parser; lines have no
    # length limit.
    raw = (spark.read.schema(schema).option("header", True).option("sep", separator)
           .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
           .option("quote", '"').option("escape", '"')
           .option("maxColumns", max(20480, 2 * len(names))).option("maxCharsPerColumn", -1)
           .option("columnPruning", False).csv(list(paths)))
    surplus = F.coalesce(_n_fields(col(CORRUPT), separator) > len(names), F.lit(False))
    raw = raw.filter(_touch(col(names[0])))
    kept = raw.filter(~surplus).select(*[col(n) for n in names])
    rejected = raw.filter(surplus).select(F.col("_metadata.file_path").alias("path"),
                                          col(CORRUPT).alias("record"))
    return kept, rejected


def _read_quoted(spark: SparkSession, paths: Sequence[str], names: Sequence[str], separator: str) -> tuple[DataFrame, DataFrame]:
    """``read_delimited`` for files with line breaks in quoted values."""
    found = splits.cut_records(spark, paths, "\n", splits.csv_scan(separator))
    # A quote that never closes is no quote: what it swallowed are lines.
    lines = found.select("path", "block", "nth", F.posexplode(F.when(F.col("whole"), F.array("record")).otherwise(F.split("record", "\n"))).alias("line", "record"))
    lines = lines.withColumn("record", F.regexp_replace("record", r"\r$", "")).where(F.trim("record") != "")
    header = lines.groupBy("path").agg(F.min(F.struct("block", "nth", "line")).alias("at"))
    rows = lines.join(header, "path").where(F.struct("block", "nth", "line") != F.col("at"))
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names] + [T.StructField(CORRUPT, T.StringType())])
    options = {"sep": separator, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "quote": '"', "escape": '"',
               "maxColumns": str(max(20480, 2 * len(names))), "maxCharsPerColumn": "-1"}
    ddl = ", ".join("`" + f.name.replace("`", "``") + "` string" for f in schema.fields)
    parsed = rows.select("path", "record", F.from_csv("record", ddl, options).alias("row"))
    n_fields = _n_fields(F.col("record"), separator)
    kept = parsed.where(n_fields <= len(names)).select(*[F.col("row")[n].alias(n) for n in names])
    return kept, parsed.where(n_fields > len(names)).select("path", "record")


def _n_fields(record, separator: str):
    """Number of values in a line: separators outside of quotes that open a value, plus one."""
    # Doubled quotes first: what is left opens and closes.  No pattern loops over a group, which Java would do on its stack.
    single = F.replace(record, F.lit('""'), F.lit("\u0001"))
    unquoted = F.regexp_replace(single, rf'(?<![^{re.escape(separator)}\u0001])"[^"]*"', "")
    return F.length(unquoted) - F.length(F.replace(unquoted, F.lit(separator), F.lit(""))) + 1


def null_tokens(df: DataFrame, tokens: Sequence[str] = NA_TOKENS) -> DataFrame:
    """Text equal to one of the load-time NA tokens becomes NULL."""
    return df.select(*[F.when(~col(c).isin(*tokens), col(c)).alias(c) if isinstance(t, T.StringType)
                       else col(c) for c, t in ((f.name, f.dataType) for f in df.schema.fields)])


def infer_types(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Text columns whose every value is a whole number, number or boolean get
    that type.  One scan; a handful of counts per column reach the driver.

    Whole numbers beyond 64 bits become decimals, beyond 38 digits they stay
    text: no digit is lost.
    """
    types = field_types(df)
    columns = [c for c in (columns or types) if isinstance(types[c], T.StringType)]
    if not columns:
        return df
    aggregates = []
    for i, c in enumerate(columns):
        s = strip(col(c))
        aggregates += [F.count(s).alias(f"n{i}"),
                       F.count_if(s.rlike(WHOLE)).alias(f"w{i}"),
                       F.count_if(s.rlike(WHOLE) & s.try_cast("bigint").isNotNull()).alias(f"l{i}"),
                       F.count_if(s.rlike(WHOLE) & s.try_cast("decimal(38,0)").isNotNull()).alias(f"e{i}"),
                       F.count(parse_number(s)).alias(f"v{i}"),
                       F.count_if(s.isin("True", "False", "TRUE", "FALSE", "true", "false")).alias(f"b{i}")]
    row = aggregate_row(df, aggregates)
    cast = {}
    for i, c in enumerate(columns):
        n = row[f"n{i}"]
        if n == 0:
            continue
        if row[f"w{i}"] == n:
            if row[f"l{i}"] == n:
                cast[c] = strip(col(c)).cast("bigint")
            elif row[f"e{i}"] == n:
                cast[c] = strip(col(c)).cast("decimal(38,0)")
        elif row[f"v{i}"] == n:
            cast[c] = parse_number(col(c))
        elif row[f"b{i}"] == n:
            cast[c] = F.lower(strip(col(c))) == "true"
    return df.select(*[cast[c].alias(c) if c in cast else col(c) for c in df.columns])


#: An object of objects whose inner keys are row labels, as far as its beginning tells.
_BY_COLUMNS = re.compile(r'\{\s*"(?:[^"\\]|\\.)*"\s*:\s*\{\s*"\d+"\s*:', re.S)


def json_layout(pieces: Iterator[tuple[str, bool]]) -> tuple[str, list[str]]:
    """("array", "lines", "document" or "columns", key order of the first
    record), from ever longer starts of a file, up to ``READ_LIMIT``.

    What follows the first whole value tells objects one per line from a
    single object; an object of objects with the same inner keys is a table
    written column by column.
    """
    decoder = json.JSONDecoder()
    for text, ended in pieces:
        body = text.lstrip()
        last = ended or len(text) >= READ_LIMIT
        if not body:
            if last:
                raise ValueError("empty file")
            continue
        if body[0] not in "[{":
            raise ValueError("not JSON")
        inner = body[1:].lstrip() if body[0] == "[" else body
        if body[0] == "[" and inner[:1] == "]":
            return "array", []
        try:
            record, end = decoder.raw_decode(inner)
        except ValueError:
            if ended:
                raise ValueError("no whole JSON value") from None
            if not last:
                continue
            if body[0] == "[":
                return "array", []
            if _BY_COLUMNS.match(body):
                return "columns", []
            return ("document" if re.match(r"\{\s*\n", body) else "lines"), []
        if body[0] == "[":
            return "array", list(record) if isinstance(record, dict) else []
        if not (body[end:].strip() or last):
            continue
        keys = list(record)
        if body[end:].strip():
            if "\n" in body[:end].strip():
                raise ValueError("several JSON documents over many lines each")
            return "lines", keys
        columns = [v for v in record.values() if isinstance(v, dict)]
        # Not merely one object with nested ones: the inner keys are row labels.
        if columns and len(columns) == len(record) and len({tuple(v) for v in columns}) == 1 and all(k.isdigit() for k in columns[0]):
            return "columns", []
        return ("document" if "\n" in body[:end].strip() else "lines"), keys
    raise ValueError("empty file")


def json_records(spark: SparkSession, paths: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """((path, record) of the objects in JSON arrays, what the end of a file cuts off): each array is cut up in many tasks."""
    found = splits.cut_records(spark, paths, "}", splits.json_scan)
    text = F.regexp_extract("record", r"(?s)(\{.*)", 1)
    rows = found.where(F.contains("record", F.lit("{"))).select("path", "whole", F.concat(text, F.when(F.col("whole"), "}").otherwise("")).alias("record"))
    return rows.where("whole").drop("whole"), rows.where("not whole").drop("whole")


def read_json_array(spark: SparkSession, paths: Sequence[str], key_order: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(rows, (path, record) of what isn't a whole object) of files that are JSON arrays of objects."""
    records, cut_off = json_records(spark, paths)
    strings = getattr(records.select("record")._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())
    schema = T._parse_datatype_json_string(spark._jsparkSession.read().option("columnNameOfCorruptRecord", CORRUPT).json(strings).schema().json())
    fields = [f for f in schema.fields if f.name != CORRUPT]
    full = T.StructType([*fields, T.StructField(CORRUPT, T.StringType())])
    parsed = records.select("path", F.from_json("record", full, {"columnNameOfCorruptRecord": CORRUPT}).alias("row"))
    bad = F.col("row")[CORRUPT]
    order = sorted((f.name for f in fields), key=lambda n: list(key_order).index(n) if n in key_order else len(key_order))
    rows = parsed.where(bad.isNull()).select(*[F.col("row")[n].alias(n) for n in order])
    return rows, parsed.where(bad.isNotNull()).select("path", bad.alias("record")).unionAll(cut_off)


def read_json_columns(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Rows, as text, of objects that map each column to {row label: value}.

    Such a file is one value; it is cut at the commas between its cells, in
    many tasks, and the cells are brought together by row label.
    """
    cells = splits.cut_records(spark, paths, ",", splits.json_entry_scan, level=2)
    string = r'"[^"\\]*(?:\\.[^"\\]*)*"'
    parts = rf'(?s)^\s*\{{?\s*(?:({string})\s*:\s*\{{)?\s*({string})\s*:\s*(.*?)\s*$'
    as_text = lambda c: F.get_json_object(F.concat(F.lit('{"v":'), c, F.lit("}")), "$.v")
    split = cells.select("path", "block", "nth", *[F.regexp_extract("record", parts, i).alias(n) for i, n in ((1, "name"), (2, "label"), (3, "value"))]).where("label <> ''")
    # What closes the column, or the whole object, follows the value.
    bare = F.regexp_replace(F.regexp_replace("value", r"(?s)\\.", ""), '"[^"]*"', "")
    surplus = F.length(F.translate(bare, "{[", "")) - F.length(F.translate(bare, "}]", ""))
    split = split.withColumn("value", F.when(surplus == 2, F.regexp_replace("value", r"(?s)\s*\}\s*\}\s*$", ""))
                             .when(surplus == 1, F.regexp_replace("value", r"(?s)\s*\}\s*$", "")).otherwise(F.col("value")))
    split = write_table(split)
    starts_ = split.where("name <> ''").select("path", "block", "nth", as_text(F.col("name")).alias("name"))
    # One row for each file, with where its columns begin.  A number stands for the file in its cells, which are dealt by
    # file and label: a file's cells would otherwise meet in one task, each with the file's whole name.
    heads = write_table(starts_.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("block", "nth", "name"))).alias("heads"))
                        .withColumn("file", F.monotonically_increasing_id()))
    names = [r["name"] for r in starts_.groupBy("name").agg(F.min(F.struct("path", "block", "nth")).alias("at")).orderBy("at").collect()]
    own = F.element_at(F.filter("heads", lambda h: F.struct(h["block"], h["nth"]) <= F.struct(F.col("block"), F.col("nth"))), -1)["name"]
    placed = (split.join(F.broadcast(heads), "path")
              .select("file", as_text(F.col("label")).alias("label"), F.array_position(F.array(*map(F.lit, names)), own).cast("int").alias("column"), as_text(F.col("value")).alias("value"))
              .repartition("file", "label"))
    return (placed.groupBy("file", "label").agg(*[F.max(F.when(F.col("column") == i + 1, F.col("value"))).alias(f"c{i}") for i in range(len(names))])
            .select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)]))


def read_json(spark: SparkSession, paths: Sequence[str], whole_file: bool, key_order: Sequence[str] = (),
              schema: T.StructType | str | None = None) -> DataFrame:
    """Records of one object per line, or of one object in all (``whole_file``).

    Without a schema Spark infers one with a scan of its own; fields keep the
    order of the first record.
    """
    reader = spark.read.option("multiLine", whole_file)
    df = (reader.schema(schema) if schema is not None else reader).json(list(paths))
    order = [k for k in key_order if k in df.columns]
    return df.select(*[col(c) for c in order + [c for c in df.columns if c not in order]])


def is_date_key(name: str) -> bool:
    n = name.lower()
    return n.endswith(("_at", "_time")) or n.startswith("timestamp") or n in ("modified", "date")


def parse_date_keys(df: DataFrame) -> DataFrame:
    """Date-like keys become timestamps when every value reads as one.

    Numbers count as time since the epoch in the coarsest unit that stays in
    range, provided all of them lie beyond the first year.
    """
    types = field_types(df)
    texts = [c for c, t in types.items() if is_date_key(c) and isinstance(t, T.StringType)]
    numbers = [c for c, t in types.items() if is_date_key(c) and isinstance(t, T.NumericType)]
    if not texts and not numbers:
        return df
    aggregates = []
    for i, c in enumerate(texts):
        aggregates += [F.count(col(c)).alias(f"n{i}"), F.count(parse_date(col(c))).alias(f"d{i}")]
    for i, c in enumerate(numbers):
        aggregates += [F.min(col(c).cast("double")).alias(f"lo{i}"), F.max(col(c).cast("double")).alias(f"hi{i}")]
    row = aggregate_row(df, aggregates)
    new = {c: parse_date(col(c)) for i, c in enumerate(texts) if row[f"n{i}"] and row[f"n{i}"] == row[f"d{i}"]}
    for i, c in enumerate(numbers):
        if row[f"lo{i}"] is not None and row[f"lo{i}"] > 31_536_000:
            per_second = next((u for limit, u in ((9.2e9, 1), (9.2e12, 1_000), (9.2e15, 1_000_000))
                               if row[f"hi{i}"] < limit), 1_000_000_000)
            micros = (col(c).cast("double") * (1_000_000 / per_second)).cast("bigint")
            new[c] = F.timestamp_micros(micros).cast("timestamp_ntz")
    return df.select(*[new[c].alias(c) if c in new else col(c) for c in df.columns])


def load_directory(spark: SparkSession, directory: str, file_types: Sequence[str] = FILE_TYPES,
                   infer: bool = True, multi_line: bool | None = None) -> LoadedTables:
    """Read every file of the given types below a directory.

    Files are grouped by header, since one CSV read would apply the first
    header to all.  A file whose first record cannot be read is named in
    ``failures``; lines that do not fit are in ``quarantine()``.
    """
    out = LoadedTables()
    for kind in file_types:
        kind = kind.lower().lstrip(".")
        files = list_files(spark, directory, kind)
        if kind == "parquet":
            if files:
                paths = [p for p, _ in files]
                out.tables.append((paths, spark.read.option("mergeSchema", True).parquet(*paths)))
            continue
        groups: dict[tuple, list[str]] = {}

        def layout(path):
            try:
                if kind == "json":
                    form, keys = json_layout(starts(spark, path))
                    return path, ("json", form, tuple(keys)), None
                record = read_start(spark, path)
                if not record.strip():
                    raise ValueError("empty file")
                sep = {"csv": ",", "tsv": "\t"}.get(kind) or sniff_separator(record)
                return path, (kind, sep, tuple(header_names(record, sep))), None
            except Exception as e:  # noqa: BLE001 - any unreadable file is skipped and named
                return path, None, str(e)

        with ThreadPoolExecutor(16) as pool:
            found = list(pool.map(layout, [p for p, _ in files]))
        for path, key, error in found:
            if error is not None:
                out.failures.append((path, error))
            else:
                groups.setdefault(key, []).append(path)
        for (form, how, names), paths in groups.items():
            if form == "json" and how == "columns":
                df = read_json_columns(spark, paths)
            elif form == "json" and how == "array":
                df, bad = read_json_array(spark, paths, names)
                if not df.columns:
                    out.failures += [(p, "no JSON records") for p in paths]
                    continue
                out.rejected.append(bad)
                df = parse_date_keys(df)
            elif form == "json":
                df = read_json(spark, paths, how != "lines", names)
                if CORRUPT in df.columns:
                    fields = [c for c in df.columns if c != CORRUPT]
                    if not fields:
                        out.failures += [(p, "no JSON records") for p in paths]
                        continue
                    df = df.filter(_touch(col(fields[0]), df.schema[fields[0]].dataType))
                    out.rejected.append(df.filter(col(CORRUPT).isNotNull()).select(
                        F.col("_metadata.file_path").alias("path"), col(CORRUPT).alias("record")))
                    df = df.filter(col(CORRUPT).isNull()).drop(CORRUPT)
                df = parse_date_keys(df)
            else:
                df, rejected = read_delimited(spark, paths, names, how, multi_line)
                out.rejected.append(rejected)
                df = null_tokens(df)
            out.tables.append((paths, infer_types(df) if infer else df))
    return out


def combine(frames: Sequence[DataFrame]) -> DataFrame:
    """Union of all columns in order of appearance, missing ones NULL.

    A column whose types disagree between frames becomes text everywhere, or
    a wider number when all are numeric and no digit is lost by it; Spark
    alone would cast and fail at run time.
    """
    if not frames:
        raise ValueError("no tables to combine")
    seen: dict[str, set] = {}
    for df in frames:
        for c, t in field_types(df).items():
            seen.setdefault(c, set()).add(t)
    target: dict[str, T.DataType] = {}
    for c, ts in seen.items():
        if len(ts) > 1:
            whole = all(isinstance(t, T.IntegralType) for t in ts)
            number = all(isinstance(t, T.NumericType) for t in ts)
            target[c] = T.LongType() if whole else T.DoubleType() if number else T.StringType()
    out = None
    for df in frames:
        # Whole numbers beyond 2^53 are no doubles.
        types = field_types(df)
        at_risk = [c for c, t in target.items() if isinstance(t, T.DoubleType) and isinstance(types.get(c), (T.LongType, T.DecimalType))]
        if at_risk:
            row = aggregate_row(df, [F.max(F.abs(col(c).cast("decimal(38,0)"))).alias(f"m{i}") for i, c in enumerate(at_risk)])
            target.update({c: T.StringType() for i, c in enumerate(at_risk) if (row[f"m{i}"] or 0) > 2 ** 53})
    for df in frames:
        types = field_types(df)
        aligned = df.drop(ROW_ID).select(*[
            (as_text(col(c), t) if isinstance(target[c], T.StringType) else col(c).cast(target[c])).alias(c)
            if c in target and target[c] != t else col(c) for c, t in types.items()])
        out = aligned if out is None else out.unionByName(aligned, allowMissingColumns=True)
    return out
