"""Row identity, column selection and tall aggregates."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..session import cut_lineage

ROW_ID = "_row_id"

# Aggregates per job: keeps generated methods small on very wide tables.  Each
# job still reads only the columns it needs.
AGGREGATES_PER_PASS = 240


def field_types(df: DataFrame) -> dict[str, T.DataType]:
    """Type of every data column; the row id is not data."""
    return {f.name: f.dataType for f in df.schema.fields if f.name != ROW_ID}


def string_columns(df: DataFrame) -> list[str]:
    return [c for c, t in field_types(df).items() if isinstance(t, T.StringType)]


def numeric_columns(df: DataFrame) -> list[str]:
    return [c for c, t in field_types(df).items() if isinstance(t, T.NumericType)]


def col(name: str) -> Column:
    """Column by exact name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def expression(template: str, name: str) -> Column:
    """SQL in which ``{value}`` stands for a column, whatever characters its name holds."""
    return F.expr(template.replace("{value}", "`" + name.replace("`", "``") + "`"))


def with_row_id(df: DataFrame, order_by: str | None = None) -> DataFrame:
    """Add ``_row_id``: a copy of the caller's key or an id from the scan.

    The scan id is stable only while the file split is; write the table once
    if ids must survive.
    """
    if ROW_ID in df.columns:
        return df
    return df.withColumn(ROW_ID, col(order_by) if order_by else F.monotonically_increasing_id())


def with_dense_index(df: DataFrame, name: str, order_by: str | None = ROW_ID) -> DataFrame:
    """Consecutive index 0..n-1 in row order, without a global window.

    Rows are range-sorted, written to the checkpoint folder (a re-run of the
    sort may cut the ranges elsewhere), and each partition's start follows from
    the partition row counts: one number per partition reaches the driver.
    """
    if order_by:
        # The hash lets the range cuts fall inside a run of equal keys.
        plain = [col(c) for c, t in field_types(df).items() if not _has_map(t)]
        ordered = df.orderBy(col(order_by), F.xxhash64(*plain))
    else:
        ordered = df
    low = F.lit((1 << 33) - 1)
    mono = F.monotonically_increasing_id()
    placed = cut_lineage(ordered.withColumn("_part", F.shiftright(mono, 33))
                         .withColumn("_pos", mono.bitwiseAND(low)))
    counts = sorted((r["_part"], r["n"]) for r in
                    placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect())
    starts, total = [], 0
    for part, n in counts:
        starts.append((part, total))
        total += n
    if not starts:
        return placed.withColumn(name, F.col("_pos")).drop("_part", "_pos")
    # Two numbers per task of the sort, so the broadcast is bounded by the
    # partition count.
    offsets = df.sparkSession.createDataFrame(starts, "_part bigint, _start bigint")
    return (placed.join(F.broadcast(offsets), "_part")
            .withColumn(name, F.col("_start") + F.col("_pos"))
            .drop("_part", "_pos", "_start"))


def aggregate_row(df: DataFrame, aggregates: Sequence[Column]) -> dict:
    """Evaluate named aggregates over the whole table; one bounded row back."""
    out: dict = {}
    for i in range(0, len(aggregates), AGGREGATES_PER_PASS):
        out.update(df.agg(*aggregates[i:i + AGGREGATES_PER_PASS]).first().asDict())
    return out


def tall_aggregates(df: DataFrame, rows: Iterable[tuple[Sequence, dict[str, Column]]],
                    labels: Sequence[tuple[str, str]], metrics: Sequence[tuple[str, str]]) -> DataFrame:
    """One output row per entry, all entries from the same pass over the data.

    ``rows`` pairs label values with the aggregate for every metric.  The
    aggregates are computed side by side in one scan and the single wide row
    is unfolded afterwards.
    """
    rows = list(rows)
    fields = list(labels) + list(metrics)
    schema = ", ".join(f"`{n}` {t}" for n, t in fields)
    if not rows:
        return df.sparkSession.createDataFrame([], schema)
    per_pass = max(1, AGGREGATES_PER_PASS // max(1, len(metrics)))
    parts = []
    for start in range(0, len(rows), per_pass):
        chunk = rows[start:start + per_pass]
        aggregates, structs = [], []
        for i, (values, exprs) in enumerate(chunk):
            items = [F.lit(v).cast(t).alias(n) for (n, t), v in zip(labels, values)]
            for n, t in metrics:
                aggregates.append(exprs[n].cast(t).alias(f"m{i}_{n}"))
                items.append(F.col(f"m{i}_{n}").alias(n))
            structs.append(F.struct(*items))
        parts.append(df.agg(*aggregates).select(F.inline(F.array(*structs))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def unpivot_text(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(column_name, value) rows for the given columns, values as text."""
    from ..functions import as_text

    types = field_types(df)
    keep = list(keep)
    if not columns:
        base = df.select(*[col(k) for k in keep]).limit(0)
        return base.withColumn("column_name", F.lit("")).withColumn("value", F.lit(""))
    narrowed = df.select(*[col(k) for k in keep],
                         *[as_text(col(c), types[c]).alias(c) for c in columns])
    return narrowed.unpivot([col(k) for k in keep], [col(c) for c in columns],
                            "column_name", "value")


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, value, n) over all columns from one scan and one shuffle.

    Counts are combined before the shuffle, so a value that fills a third of
    the table is one row per task.
    """
    return (unpivot_text(df, columns).groupBy("column_name", "value")
            .agg(F.count(F.lit(1)).alias("n")))


def first_cells(df: DataFrame, wanted: dict[str, Column], k: int) -> DataFrame:
    """(column_name, row id, value): the first k cells, in row order, of each column for which its condition holds.

    One scan for any number of columns: the cells that qualify are unfolded,
    and the rank filter keeps k of each column in every task before the shuffle.
    """
    from ..functions import as_text

    types = field_types(df)
    if not wanted:
        return df.select(F.lit("").alias("column_name"), ROW_ID, F.lit("").alias("value")).limit(0)
    cells = F.array(*[F.when(p, F.struct(F.lit(c).alias("column_name"), as_text(col(c), types[c]).alias("value"))) for c, p in wanted.items()])
    w = Window.partitionBy("column_name").orderBy(ROW_ID)
    return (df.select(ROW_ID, F.explode(F.filter(cells, lambda x: x.isNotNull())).alias("cell"))
            .select("cell.column_name", ROW_ID, "cell.value")
            .withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).drop("rank"))


def is_numeric(t: T.DataType) -> bool:
    return isinstance(t, T.NumericType)


def is_temporal(t: T.DataType) -> bool:
    return isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType))


def groupable(df: DataFrame) -> DataFrame:
    """Maps and variants as JSON text, so that whole rows can be grouped."""
    out = df
    for name, dtype in field_types(df).items():
        if _has_map(dtype):
            out = out.withColumn(name, F.to_json(col(name)))
    return out


def _has_map(t: T.DataType) -> bool:
    if isinstance(t, (T.MapType, T.VariantType)):
        return True
    if isinstance(t, T.ArrayType):
        return _has_map(t.elementType)
    if isinstance(t, T.StructType):
        return any(_has_map(f.dataType) for f in t.fields)
    return False
