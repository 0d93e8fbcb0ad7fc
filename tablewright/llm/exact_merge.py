"""Exact duplicates by a tree-merge of digest runs.

Rows are dealt to runs by a hash of their id.  Inside a run, equal texts
collapse to one entry of the run: digest, checks, keeper, number of rows.  Then
runs meet in binomial rounds: run r joins the run whose number lacks r's lowest
``log2(fan_in)`` bits, and a multiway merge keeps one verified entry for each
digest.  After the last round every digest has a single entry.  A digest
counts as the same text only if the byte length and a second, independent hash agree
as well; entries that disagree stay apart at every level.

The runs spread a text that fills a third of the table over all of them: no task
sees more than one run's share of it, and each round passes on one entry for each run and digest.
The texts themselves are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from .common import ascii_lower, col, text_of, write_table

RUNS = 4096
FAN_IN = 16
_ENTRY = ("digest", "check", "n_bytes")


def _digests(text: Column) -> dict[str, Column]:
    normal = ascii_lower(text_of(text))
    return {"digest": F.unhex(F.sha2(normal, 256)), "check": F.xxhash64(normal), "n_bytes": F.octet_length(normal)}


def merge_runs(runs: DataFrame, fan_in: int, levels: int, largest: bool) -> DataFrame:
    """Merge entries (run, digest, check, n_bytes, keeper, n) until one run is left."""
    best = F.max if largest else F.min
    for _ in range(levels):
        runs = (runs.withColumn("run", F.floor(F.col("run") / fan_in))
                .groupBy("run", *_ENTRY).agg(best("keeper").alias("keeper"), F.sum("n").alias("n")))
    return runs


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", largest: bool = True,
                 runs: int = RUNS, fan_in: int = FAN_IN) -> DataFrame:
    """One row for each input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after lower-casing A-Z.  Of equal texts the row with the largest id stays (the
    smallest with ``largest=False``).  ``runs`` must be a power of ``fan_in``.

    Null text counts as empty; empty texts form one group.  A null id is beaten by any other id; if a group has only
    null ids, one of its rows stays and ``keep_id`` is null.  Of rows that repeat both id and text, one stays.  Rows
    that repeat an id with other texts are judged text by text.  An empty table gives an empty result; further columns are ignored.
    """
    levels, reach = 0, 1
    while reach < runs:
        reach, levels = reach * fan_in, levels + 1
    if reach != runs:
        raise ValueError("runs must be a power of fan_in")
    rows = write_table(df.select(col(id_col).alias("doc_id"), *[c.alias(n) for n, c in _digests(col(text_col)).items()])
                       .withColumn("run", F.pmod(F.xxhash64("doc_id"), F.lit(runs))))
    best = F.max if largest else F.min
    leaves = rows.groupBy("run", *_ENTRY).agg(best("doc_id").alias("keeper"), F.count(F.lit(1)).alias("n"))
    merged = (merge_runs(leaves, fan_in, levels, largest)
              .select(*_ENTRY, F.col("keeper").alias("keep_id"), F.col("n").alias("group_size")))
    # Back down: a digest has at most one entry for each run, and a run only its share of a large group.
    entries = leaves.select("run", *_ENTRY).join(merged, list(_ENTRY))
    order = F.col("doc_id").desc_nulls_last() if largest else F.col("doc_id").asc_nulls_last()
    first = F.row_number().over(Window.partitionBy("run", *_ENTRY).orderBy(order)) == 1
    return (rows.join(entries, ["run", *_ENTRY])
            .select("doc_id", "keep_id", "group_size",
                    (first & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
                    F.lower(F.hex("digest")).alias("text_sha256")))


def drop_exact_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``df`` that :func:`exact_groups` keeps, with the columns of ``df``."""
    # One key for join and window: texts cross the network once.
    key = lambda doc, digest: F.struct(doc.alias("doc"), digest.alias("digest")).alias("_key")
    kept = exact_groups(df, id_col, text_col, **options).where("kept").select(key(F.col("doc_id"), F.unhex("text_sha256")))
    digest = F.unhex(F.sha2(ascii_lower(text_of(col(text_col))), 256))
    both = df.select(F.struct(*[col(c) for c in df.columns]).alias("_row"), key(col(id_col), digest)).join(kept, "_key")
    # Rows that repeat id and text all match; the join has them side by side already.
    once = F.row_number().over(Window.partitionBy("_key").orderBy(F.lit(0)))
    return both.withColumn("_nth", once).where("_nth = 1").select("_row.*")
