"""SimHash near-duplicates by tiled exact comparison.

A fingerprint has 64 bits, one for each bit that more than half of a text's
word-shingle hashes set.  Two fingerprints within ``radius`` bits agree wholly on at least one of
``radius + 1`` blocks of bits, so each distinct fingerprint is dealt to one bucket for
each block, and only buckets are compared.  A bucket is cut into tiles of bounded
size: one tile where it fits, else tiles by population count and hash.  Tile pairs whose
population counts differ by more than the radius hold no link and are never formed;
the others are compared exactly with exclusive-or and bit counts.  A tile pair
returns a spanning forest of its links, at most one row for each fingerprint,
so a group of near copies never becomes all its pairs.

Components grow by alternating large-star and small-star rounds on distinct
fingerprints, written to the shared folder after each round.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from .common import col, ship_with_tasks, write_table

SHINGLE_WORDS = 3
RADIUS = 3
SEED = 42
TILE = 2048
#: Shingles whose bits are added up at once.
CHUNK = 1 << 16


def fingerprint(text: str | None, words_in_shingle: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """Unsigned 64-bit SimHash of a whole text; 0 for a text without words."""
    # bytes.lower() and bytes.split() know ASCII letters and ASCII white space only.
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - words_in_shingle + 1)
    digest = partial(xxhash.xxh64_intdigest, seed=seed)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        part = words[at:at + CHUNK + words_in_shingle - 1]
        if len(words) < words_in_shingle:
            shingles, count = [b" ".join(words)], 1
        else:
            shingles, count = map(b" ".join, zip(*[part[k:] for k in range(words_in_shingle)])), len(part) - words_in_shingle + 1
        hashes = np.fromiter(map(digest, shingles), np.uint64, count)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def text_hash(text: Column) -> Column:
    """64-bit hash that tells apart the texts under one id."""
    return F.xxhash64(text.cast("string"))


def with_fingerprint(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     words_in_shingle: int = SHINGLE_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, hash, fp) for each row; hash is the text's, fp the fingerprint as a signed 64-bit integer."""
    ids = df.schema[id_col].dataType

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), words_in_shingle, seed) for t in batch.column(2)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps.view(np.int64))], ["doc_id", "hash", "fp"])

    rows = df.select(col(id_col).alias("doc_id"), text_hash(col(text_col)).alias("hash"), col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {ids.simpleString()}, hash bigint, fp bigint")


def forest(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between fingerprints at most ``radius`` bits apart.

    Breadth first.  The points not reached yet stay sorted by population count, so
    each point is compared only with those whose count is within the radius.
    """
    fps = fps[np.argsort(np.bitwise_count(fps), kind="stable")]
    bits = np.bitwise_count(fps).astype(np.int16)
    here, there = [], []
    while len(fps):
        queue, fps, bits = [fps[0]], fps[1:], bits[1:]
        while queue and len(fps):
            point = queue.pop()
            own = int(np.bitwise_count(point))
            lo, hi = np.searchsorted(bits, [own - radius, own + radius + 1])
            near = np.flatnonzero(np.bitwise_count(fps[lo:hi] ^ point) <= radius) + lo
            if len(near):
                found = fps[near]
                here.append(np.full(len(found), point, np.uint64))
                there.append(found)
                queue.extend(found)
                left = np.ones(len(fps), bool)
                left[near] = False
                fps, bits = fps[left], bits[left]
    if not here:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    return np.concatenate(here), np.concatenate(there)


def _compare_tiles(radius: int):
    """Forests of the tile pairs in batches sorted by (bucket, pair)."""

    def links(rows: list[np.ndarray]):
        fps = np.unique(np.concatenate(rows))
        return forest(fps.view(np.uint64), radius) if len(fps) > 1 else None

    def run(batches):
        key, rows = None, []
        for batch in batches:
            names = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)]
            fps = batch.column(3).to_numpy(zero_copy_only=False)
            if not len(fps):
                continue
            new = np.flatnonzero(np.any([n[1:] != n[:-1] for n in names], axis=0)) + 1
            edges = np.concatenate([[0], new, [len(fps)]])
            a, b = [], []
            for lo, hi in zip(edges[:-1], edges[1:]):
                now = tuple(int(n[lo]) for n in names)
                if now != key:
                    if rows and (found := links(rows)):
                        a.append(found[0]), b.append(found[1])
                    key, rows = now, []
                rows.append(fps[lo:hi])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], ["a", "b"])
        if rows and (found := links(rows)):
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in found], ["a", "b"])

    return run


def near_links(points: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Links (a, b) that connect the distinct fingerprints ``fp`` exactly as all links within ``radius`` do."""
    blocks = radius + 1
    cuts = [64 * k // blocks for k in range(blocks + 1)]
    block = lambda k: F.shiftrightunsigned("fp", cuts[k]).bitwiseAND(F.lit((1 << (cuts[k + 1] - cuts[k])) - 1))
    dealt = points.select("fp", F.posexplode(F.array(*[block(k) for k in range(blocks)])).alias("block", "value"))
    sizes = dealt.groupBy("block", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    dealt = dealt.join(sizes, ["block", "value"])
    # Buckets that fit are one tile.
    single = (dealt.where(F.col("n") <= tile)
              .select(F.pmod(F.xxhash64("block", "value"), F.lit(1 << 40)).alias("bucket"), F.lit(0).alias("p"), F.lit(0).alias("q"), "fp"))
    # Others: tiles by population count, larger counts cut further by hash.
    large = dealt.where(F.col("n") > tile).withColumn("bits", F.bit_count("fp"))
    parts = large.groupBy("block", "value", "bits").agg(F.ceil(F.count(F.lit(1)) / tile).alias("cut"))
    tiles = parts.select("block", "value", "bits", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("cut") - 1)).alias("nth"))
    tile_no = (F.col("bits") * (1 << 20) + F.col("nth")).cast("bigint")
    ours = (large.join(parts, ["block", "value", "bits"])
            .select("block", "value", "bits", "fp", (F.col("bits") * (1 << 20) + F.pmod(F.xxhash64("fp"), F.col("cut"))).cast("bigint").alias("own")))
    # Both tiles of a pair get a copy of each row: to every tile of the bucket within the radius in population count.
    others = tiles.select("block", "value", F.col("bits").alias("other_bits"), tile_no.alias("other"))
    near = [ours["block"] == others["block"], ours["value"] == others["value"], F.abs(ours["bits"] - others["other_bits"]) <= radius]
    pairs = (ours.join(others, near)
             .select(F.pmod(F.xxhash64(ours["block"], ours["value"]), F.lit(1 << 40)).alias("bucket"),
                     F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "fp"))
    work = single.select("bucket", F.col("p").cast("bigint"), F.col("q").cast("bigint"), "fp").unionByName(pairs)
    work = work.repartition("bucket", "p", "q").sortWithinPartitions("bucket", "p", "q")
    return work.mapInArrow(_compare_tiles(radius), "a bigint, b bigint")


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node with a link: root is the smallest node that it reaches.

    Large-star hangs each larger neighbour of a node on the smallest one, small-star each smaller one; once neither
    changes an edge all components are stars.  The number of rounds grows with the logarithm of the longest path.
    """
    both = lambda e: e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def large_star(edges: DataFrame) -> DataFrame:
        around = both(edges)
        low = around.groupBy("a").agg(F.min("b").alias("low")).withColumn("low", F.least("low", "a"))
        hung = around.join(low, "a").where(F.col("b") > F.col("a"))
        return hung.select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()

    def small_star(edges: DataFrame) -> DataFrame:
        low = edges.groupBy("a").agg(F.min("b").alias("low"))
        hung = edges.join(low, "a").where(F.col("b") != F.col("low")).select(F.col("b").alias("a"), F.col("low").alias("b"))
        return hung.unionAll(low.select("a", F.col("low").alias("b"))).distinct()

    state = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    down = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = write_table(down)
    before = state(edges)
    while before[0]:
        edges = write_table(small_star(large_star(edges)))
        now = state(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _labelled(df: DataFrame, id_col: str, text_col: str, radius: int, words_in_shingle: int, tile: int) -> DataFrame:
    """(doc_id, hash, fp, root, component_id) for each row; root is one fingerprint of the component."""
    docs = write_table(with_fingerprint(df, id_col, text_col, words_in_shingle))
    points = write_table(docs.groupBy("fp").agg(F.min("doc_id").alias("low_id")))
    roots = components(near_links(points, radius, tile))
    rooted = points.join(roots, points["fp"] == roots["node"], "left").select("fp", "low_id", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("low_id").alias("component_id"))
    return docs.join(rooted.join(ids, "root").select("fp", "root", "component_id"), "fp")


def near_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS,
                words_in_shingle: int = SHINGLE_WORDS, tile: int = TILE) -> DataFrame:
    """One row for each input row: ``doc_id, fingerprint (16 hex digits), component_id``.

    ``component_id`` is the smallest id among all documents that links reach.  Every link between different
    fingerprints counts; equal fingerprints are one point, so copies cost nothing more.

    Null text counts as empty; texts without words have fingerprint 0, which links like any other.  Null ids never
    are a component id unless the component has only null ids.  Repeated rows each get a row.  An empty table gives
    an empty result; further columns are ignored.
    """
    rows = _labelled(df, id_col, text_col, radius, words_in_shingle, tile)
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def first_of_each(df: DataFrame, rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row of ``df`` for each root in ``rows`` (doc_id, hash, root): the one with the smallest id, null last, then the smallest hash."""
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash")).alias("first"))
    # One key for join and window, never null: texts cross the network once.
    key = lambda c, h: F.struct(c.alias("doc"), h.alias("hash")).alias("_key")
    keep = first.select(key(F.col("first.doc_id"), F.col("first.hash")))
    both = df.select(F.struct(*[col(c) for c in df.columns]).alias("_row"), key(col(id_col), text_hash(col(text_col)))).join(keep, "_key")
    # Rows that repeat id and text all match; the join has them side by side already.
    once = F.row_number().over(Window.partitionBy("_key").orderBy(F.lit(0)))
    return both.withColumn("_nth", once).where("_nth = 1").select("_row.*")


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS,
                     words_in_shingle: int = SHINGLE_WORDS, tile: int = TILE) -> DataFrame:
    """One row of ``df`` for each component, that with the smallest id.

    Rows that repeat an id, or have none, are judged text by text: each component keeps a row of its own.  Columns
    keep their names and values.
    """
    return first_of_each(df, _labelled(df, id_col, text_col, radius, words_in_shingle, tile), id_col, text_col)


ship_with_tasks(__name__)
