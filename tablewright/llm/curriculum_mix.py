"""Mixing sources to target weights along a time-varying curriculum.

Every source has a weight schedule over training time 0..1.  The schedule is
piecewise linear; its integral, scaled to the source's target, is the demand for
that source's words up to a time.  A source serves its documents in a fixed
pseudo-random order, as often as the target needs; the word at which a document starts
is a point of the cumulative demand, and the inverted integral turns it into a
training position.  A range-sort by position gives the training order.

Word positions inside a source come from bucket totals plus a running sum inside
each bucket, so a source with a third of all rows is 4,096 window groups, not one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from .common import col, text_of, word_count, write_table

WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3
#: (time, weight) knots for each place in WEIGHTS: light sources fade, heavy ones rise.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 0.75), (1.0, 1.75)))


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Targets for (source, source_size) rows, one row for each source: adds ``place, weight, target``.

    Sources take ``weights`` in code-point order, null last, again and again.  A target never exceeds ``max_repeats``
    times the source's size; what is over is shared anew by weight.  That fixed point is a water level: sources reach
    their cap in the order of cap over weight, so sums over that order tell which are full and the level of the others.
    The table holds one row for each source; it's sorted in one task.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(weights)
    ranked = (sizes.withColumn("place", place)
              .withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("place") + 1))
              .withColumn("cap", F.col("source_size") * max_repeats))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, all_rows = fill.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    total = F.sum("source_size").over(all_rows)
    level = ((total - F.coalesce(F.sum("cap").over(before), F.lit(0)))
             / F.sum("weight").over(fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    ranked = ranked.withColumn("level", level).withColumn("full", F.col("cap") <= F.col("level") * F.col("weight"))
    # From the first source that isn't full on, the level stands.
    nth = F.row_number().over(fill)
    ranked = ranked.withColumn("nth", nth)
    water = F.min(F.when(~F.col("full"), F.struct("nth", "level"))).over(all_rows)["level"]
    return (ranked.withColumn("target", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(water * F.col("weight")))
            .select("source", "source_size", "place", "weight", "target"))


def time_of_demand(share: Column, place: Column, schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES) -> Column:
    """The time at which a schedule's integral reaches ``share`` of its whole.

    On a segment from (t0, w0) with slope s the integral is w0 x + s x^2 / 2; its root is written without a difference of
    like numbers.  Shares at or below 0 give the time of the first knot.
    """
    out = F.lit(None).cast("double")
    for k, knots in reversed(list(enumerate(schedules))):
        areas = [(t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:])]
        whole, at = sum(areas), sum(areas)
        expr = F.lit(None).cast("double")
        for ((t0, w0), (t1, w1)), area in reversed(list(zip(zip(knots, knots[1:]), areas))):
            at -= area
            rest = share * F.lit(whole) - F.lit(at)
            slope = (w1 - w0) / (t1 - t0)
            root = 2 * rest / (F.lit(w0) + F.sqrt(F.greatest(F.lit(0.0), F.lit(w0 * w0) + F.lit(2 * slope) * rest)))
            here = F.when(rest <= 0, F.lit(t0)).otherwise(F.least(F.lit(t1), F.lit(t0) + root))
            expr = here if at + area == whole else F.when(share * F.lit(whole) <= F.lit(at + area), here).otherwise(expr)
        out = F.when(place == k, expr).otherwise(out)
    return out


def _placed(df: DataFrame, id_col: str, text_col: str, source_col: str, weights, max_repeats) -> DataFrame:
    """Documents with size, source figures and ``start``, the words before them in their source's order."""
    text = text_of(col(text_col))
    key = F.md5(F.coalesce(col(id_col).cast("string"), F.lit("")))
    base = df.select(col(id_col).alias("doc_id"), col(source_col).cast("string").alias("source"),
                     word_count(text).alias("size"), key.alias("key"))
    # Ties: repeated ids are told apart by nothing but their size, and rows of equal size are alike.
    base = write_table(base.withColumn("bucket", F.substring("key", 1, 3)))
    in_bucket = base.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    sizes = in_bucket.groupBy("source").agg(F.sum("bucket_size").alias("source_size"))
    before = (F.sum("bucket_size").over(Window.partitionBy("source").orderBy("bucket")) - F.col("bucket_size"))
    offsets = in_bucket.withColumn("bucket_start", before).drop("bucket_size")
    targets = source_targets(sizes, weights, max_repeats)
    offsets = offsets.join(targets.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    place = F.struct("source", "bucket")
    offsets = offsets.withColumn("_place", place).drop("source", "bucket")
    rows = base.withColumn("_place", place).join(offsets, "_place")
    inside = Window.partitionBy("_place").orderBy("key", "doc_id", "size")
    inside = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("start", F.col("bucket_start") + F.sum("size").over(inside) - F.col("size"))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: Sequence[float] = WEIGHTS, max_repeats: int = MAX_REPEATS,
        schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES) -> DataFrame:
    """One row for each document: ``doc_id, source, size, source_size, target, taken, full_copies, part_words, position``.

    ``size`` counts words.  ``full_copies`` passes over the source are whole; the pass after them ends inside one
    document, of which ``part_words`` words are taken; ``taken`` is the sum, so that a source's taken words equal its target
    rounded to whole words.  ``position`` is the training time (0 to 1) at which the document first appears, null if it isn't
    taken; rows come range-sorted by it.

    Null text has no words.  A null source is a source of its own, last in order.  Documents without words take nothing.
    Null and repeated ids are allowed; rows alike in id, source and size share their places in some order.  An empty table
    gives an empty result; further columns are ignored.
    """
    rows = _placed(df, id_col, text_col, source_col, weights, max_repeats)
    demand = F.round("target").cast("bigint")
    size = F.greatest(F.col("source_size"), F.lit(1))
    rows = (rows.withColumn("full_copies", F.floor(demand / size).cast("bigint"))
            .withColumn("rest", demand - F.col("full_copies") * F.col("source_size"))
            .withColumn("part_words", F.greatest(F.lit(0).cast("bigint"), F.least(F.col("size"), F.col("rest") - F.col("start"))))
            .withColumn("taken", F.col("full_copies") * F.col("size") + F.col("part_words")))
    share = F.col("start") / F.greatest(demand, F.lit(1))
    position = F.when(F.col("taken") > 0, time_of_demand(share, F.col("place"), schedules))
    return (rows.withColumn("position", position)
            .select("doc_id", "source", "size", "source_size", "target", "taken", "full_copies", "part_words", "place", "start", "position")
            .orderBy(F.col("position").asc_nulls_last(), "doc_id"))


def mixed_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                    weights: Sequence[float] = WEIGHTS, max_repeats: int = MAX_REPEATS,
                    schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES) -> DataFrame:
    """The mix itself: a row with the columns of ``df`` for each time a document is taken, range-sorted by position.

    Documents are taken whole: the one of a source in which the last pass ends is taken once more, so a source exceeds its
    target by less than one document.  Nulls, repeats and empty tables as in :func:`mix`; a column of ``df`` keeps its
    values whatever its name.
    """
    keys = ("doc_id", "source", "size")
    plan = mix(df, id_col, text_col, source_col, weights, max_repeats, schedules)
    # Rows alike in all keys are neighbours in their source's order, so their parts are whole, then cut, then nothing.
    plan = (plan.groupBy(*keys)
            .agg(F.min("start").alias("start"), F.sum("part_words").alias("parts"), F.first("full_copies").alias("full_copies"),
                 F.first("target").alias("target"), F.first("source_size").alias("source_size"), F.first("place").alias("place"))
            .select(F.struct(*keys).alias("_key"), "start", "parts", "full_copies", "target", "source_size", "place"))
    rows = df.select(F.struct(*[col(c) for c in df.columns]).alias("_row"), col(id_col).alias("doc_id"),
                     col(source_col).cast("string").alias("source"), word_count(text_of(col(text_col))).alias("size"))
    # One key for join and window, never null itself: texts cross the network once before the sort.
    rows = rows.withColumn("_key", F.struct(*keys)).join(plan, "_key")
    nth = F.row_number().over(Window.partitionBy("_key").orderBy(F.lit(0))) - 1
    rows = (rows.withColumn("_nth", nth)
            .withColumn("_part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("parts") - F.col("_nth") * F.col("size"))))
            .withColumn("_copies", F.col("full_copies") + (F.col("_part") > 0).cast("int"))
            .where((F.col("_copies") > 0) & (F.col("size") > 0))
            .withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_copies") - 1))))
    start = F.col("start") + F.col("_nth") * F.col("size") + F.col("_copy") * F.col("source_size")
    share = start / F.greatest(F.round("target").cast("bigint"), F.lit(1))
    rows = rows.withColumn("_position", time_of_demand(share, F.col("place"), schedules))
    # What the sort carries is a row and its place, the text once.
    ready = rows.select("_row", "_position", F.col("doc_id").alias("_id"))
    return ready.orderBy("_position", "_id").select("_row.*")
