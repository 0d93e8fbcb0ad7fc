"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import string
import sys
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.rows import col
from ..session import ensure_checkpoint_dir, ship_with_tasks, write_table

__all__ = ["ascii_lower", "bit_filter", "col", "process_cache", "scratch_path", "ship_with_tasks", "text_of", "word_count", "write_table"]

WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def text_of(column: Column) -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(column.cast("string"), F.lit(""))


def word_count(text: Column) -> Column:
    """Number of runs of anything but space, tab, newline, vertical tab, form feed and return."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("bigint")


def scratch_path(spark: SparkSession, kind: str) -> str:
    """A new path in the folder that all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{kind}/{uuid.uuid4().hex}"


def bit_filter(bits: DataFrame, log_size: int) -> np.ndarray:
    """The bits in column ``bit`` as 2^log_size packed bits, lowest first: that size whatever the number of rows."""
    number = F.col("bit").cast("bigint") + 1
    rows = bits.groupBy(F.bitmap_bucket_number(number).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("bits"))
    out = np.zeros((1 << log_size) // 8, np.uint8)
    for row in rows.collect():
        at = (row["part"] - 1) * 4096
        own = np.frombuffer(bytes(row["bits"]), np.uint8)[:len(out) - at]
        out[at:at + len(own)] = own
    return out


def process_cache(key: str, make):
    """An object made once in each Python process; tasks that follow find it again."""
    store = sys.__dict__.setdefault("_tablewright_process_cache", {})
    if key not in store:
        store[key] = make()
    return store[key]


ship_with_tasks(__name__)
