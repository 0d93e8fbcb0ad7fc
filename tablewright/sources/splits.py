"""Cut one large document into records in many tasks.

A quoted CSV value may hold line breaks and a JSON array is a single value, so where a record ends depends on all that
comes before.  Spark's text reader still splits such a file: at any separator byte, here line feeds or closing braces.  What
a piece does to the reader's state is a small function (inside a string or not, nesting depth), and functions compose:

1. each block of a file sums up its pieces for both states it may begin in: one row for a block;
2. folding those rows in order gives the state in which each block really begins;
3. each block cuts its pieces into records; what is left over at its ends is joined up, a few rows for a block.

Nothing but file names passes through the driver, and no task reads more than its block.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import ship_with_tasks, write_table

#: (inside a string at the end, change of depth) of a piece that begins inside one or not.
Scan = Callable[[str, bool], tuple[bool, int]]
_STRING = re.compile(r'"(?:[^"\\]|\\.)*"', re.S)
_REST = re.compile(r'(?:[^"\\]|\\.)*"', re.S)
RECORD, OPEN, MIDDLE, CLOSE = 0, 1, 2, 3


def csv_scan(separator: str) -> Scan:
    """Lines of delimited text: a quote opens a value only where the value begins, and doubled ones are part of it."""
    end_of_value = re.compile(r'"(?!")')
    skip = re.compile(r'(?:""|[^"])*')
    sep = re.escape(separator)
    plain = re.compile(rf'[^{sep}]*')

    def scan(line: str, inside: bool) -> tuple[bool, int]:
        if '"' not in line:
            return inside, 0
        at, n = 0, len(line)
        while True:
            if inside:
                at = skip.match(line, at).end()
                if at >= n or not end_of_value.match(line, at):
                    return True, 0
                inside, at = False, at + 1
            elif at < n and line[at] == '"':
                inside, at = True, at + 1
                continue
            # On to the next value.
            at = plain.match(line, at).end() + 1
            if at > n:
                return False, 0

    return scan


def json_scan(piece: str, inside: bool) -> tuple[bool, int]:
    """Text up to a closing brace, the brace included: whether it lies in a string, and braces opened less braces closed."""
    at = 0
    if inside:
        found = _REST.match(piece)
        if not found:
            return True, 0
        at = found.end()
    bare = _STRING.sub("", piece[at:])
    if '"' in bare:
        return True, bare[:bare.index('"')].count("{")
    return False, bare.count("{") - 1


def json_entry_scan(piece: str, inside: bool) -> tuple[bool, int]:
    """Text up to a comma: whether it lies in a string, and braces and brackets opened less those closed."""
    at = 0
    if inside:
        found = _REST.match(piece)
        if not found:
            return True, 0
        at = found.end()
    bare = _STRING.sub("", piece[at:])
    bare, quote, _ = bare.partition('"')
    return bool(quote), bare.count("{") + bare.count("[") - bare.count("}") - bare.count("]")


def pieces(spark: SparkSession, paths: Sequence[str], separator: str) -> DataFrame:
    """(path, block, text) in file order within each block."""
    rows = spark.read.option("lineSep", separator).text(list(paths))
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("text"))


def _runs(batches):
    """(path, block, texts) of each run of rows from one block; a block may come in several runs."""
    for batch in batches:
        paths, blocks = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        texts, begin = batch.column(2).to_pylist(), 0
        for i in range(1, len(texts) + 1):
            if i == len(texts) or blocks[i] != blocks[begin] or paths[i] != paths[begin]:
                yield (paths[begin], blocks[begin]), texts[begin:i], batch, begin
                begin = i


def block_states(rows: DataFrame, scan: Scan) -> DataFrame:
    """(path, block, inside, depth): the state in which each block begins."""
    def sums(batches):
        key, state = None, None
        out = []
        for now, texts, _, _ in _runs(batches):
            if now != key:
                if key is not None:
                    out.append((*key, *state))
                key, state = now, [False, 0, True, 0]
            for text in texts:
                a, d = scan(text, state[0])
                # Pieces without a quote do the same to both.
                b, e = (a, d) if state[0] == state[2] else scan(text, state[2])
                state = [a, state[1] + d, b, state[3] + e]
        if key is not None:
            out.append((*key, *state))
        names = ["path", "block", "in0", "d0", "in1", "d1"]
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out])

    def fold(batches):
        path, inside, depth = None, False, 0
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["path"] != path:
                    path, inside, depth = r["path"], False, 0
                out.append({"path": path, "block": r["block"], "inside": inside, "depth": depth})
                inside, depth = (r["in1"], depth + r["d1"]) if inside else (r["in0"], depth + r["d0"])
            if out:
                yield pa.RecordBatch.from_pylist(out)

    # One short row for each block of a file: the table of a file is folded by one task.
    found = rows.mapInArrow(sums, "path string, block bigint, in0 boolean, d0 bigint, in1 boolean, d1 bigint")
    return write_table(found.repartition("path").sortWithinPartitions("path", "block").mapInArrow(fold, "path string, block bigint, inside boolean, depth bigint"))


def cut_records(spark: SparkSession, paths: Sequence[str], separator: str, scan: Scan, level: int = 0) -> DataFrame:
    """(path, block, nth, whole, record): records in file order by block and nth; ``whole`` is false for one that the file's end
    cuts off.  A record ends with the piece that brings the depth down to ``level``."""
    rows = pieces(spark, paths, separator)
    # As many rows as tasks that read the files.
    begun = rows.join(F.broadcast(block_states(rows, scan)), ["path", "block"]).select("path", "block", "text", "inside", "depth")

    def cut(batches):
        key, inside, depth, parts, nth, first = None, False, 0, [], 0, False
        out: list = []

        def leave():
            # What a block leaves open goes on in the next one.
            nonlocal nth
            if parts:
                out.append((*key, nth, MIDDLE if first else OPEN, separator.join(parts)))
                nth += 1

        def made():
            names = ["path", "block", "nth", "kind", "record"]
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string()))], names)
            out.clear()
            return batch

        for now, texts, batch, begin in _runs(batches):
            if now != key:
                if key is not None:
                    leave()
                key, parts, nth = now, [], 0
                inside, depth = batch.column(3)[begin].as_py(), batch.column(4)[begin].as_py()
                first = inside or depth > level      # the record under way began in an earlier block
            for text in texts:
                inside, change = scan(text, inside)
                depth += change
                parts.append(text)
                if not inside and depth <= level:
                    out.append((*key, nth, CLOSE if first else RECORD, separator.join(parts)))
                    parts, first, nth = [], False, nth + 1
            if len(out) >= 4096:
                yield made()
        if key is not None:
            leave()
        if out:
            yield made()

    found = write_table(begun.mapInArrow(cut, "path string, block bigint, nth bigint, kind int, record string"))
    whole = found.where(F.col("kind") == RECORD).select("path", "block", "nth", F.lit(True).alias("whole"), "record")
    # A record over several blocks: the open end of one, blocks that it fills, and the beginning of the last.
    ends = found.where(F.col("kind") != RECORD)
    order = "PARTITION BY path ORDER BY block, nth ROWS UNBOUNDED PRECEDING"
    ends = ends.withColumn("owner", F.expr(f"sum(CASE WHEN kind = {OPEN} THEN 1 ELSE 0 END) OVER ({order})"))
    joined = (ends.groupBy("path", "owner")
              .agg(F.sort_array(F.collect_list(F.struct("block", "nth", "record", "kind"))).alias("parts"))
              .select("path", F.col("parts")[0]["block"].alias("block"), F.col("parts")[0]["nth"].alias("nth"),
                      (F.element_at("parts", -1)["kind"] == CLOSE).alias("whole"), F.array_join(F.col("parts")["record"], separator).alias("record")))
    return whole.unionAll(joined)


ship_with_tasks(__name__)
