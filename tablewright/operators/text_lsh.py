"""Near copies among long texts: banded MinHash, one verified link for each step of a group.

Two texts are near copies if their sets of word shingles have a Jaccard similarity of ``least``.  A set's signature is cut into
bands; sets that agree in a whole band meet in a bucket.  Within a bucket rows are ordered by further signature
values, so the most alike stand close, and each row is compared by one-bit sketches with the rows just before it and
with the bucket's head: at most three candidates for a row and band, however large the bucket, so the work is linear in texts times
bands.  Rows are range-sorted by bucket, order and key, so a bucket that half of the table shares is dealt to many tasks.

Candidates are verified on whole sets, first each text with its best one, then those that would still join two
groups.  Nothing unlike is ever linked; what the bands may miss is stated by ``expected_recall`` and measured in the tests.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..session import ship_with_tasks, write_table
from .graph import components
from .rows import col

SHINGLE_WORDS, LEAST = 5, (4, 5)
BANDS, ROWS = 24, 5
#: Rows before each that it is compared with, and differing bits of the sketch that a candidate may have: near copies at
#: the least similarity differ in 12 of 120 on average, with a standard deviation of 3.3.
TILE, RADIUS = 32, 26
SEED, FILTER_BITS, SLICE = 42, 24, 256
_RANDOM = np.random.default_rng(SEED)
_FACTOR = _RANDOM.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = _RANDOM.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def expected_recall(similarity: float, bands: int = BANDS, rows: int = ROWS) -> float:
    """Share of pairs of that similarity that agree in a whole band."""
    return 1 - (1 - similarity ** rows) ** bands


def shingles(text: str | bytes | None, words_in_shingle: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a whole text's word shingles, A-Z in lower case; a shorter text is one shingle."""
    raw = text if isinstance(text, bytes) else (text or "").encode("utf-8", "surrogatepass")
    words = raw.lower().split() or [b""]           # of bytes: ASCII letters and ASCII white space only
    hashes = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=SEED), words), np.uint64, len(words))
    k = min(words_in_shingle, len(words))
    n = len(words) - k + 1
    mixed = np.full(n, k, np.uint64)
    for i in range(k):
        mixed = mixed * _MIX + hashes[i:i + n]
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def set_key(found: np.ndarray) -> int:
    """Signed 64-bit hash of a whole set."""
    return xxhash.xxh64_intdigest(found.tobytes(), seed=SEED) - (1 << 63)


def signature(found: np.ndarray) -> np.ndarray:
    low = np.full(len(_FACTOR), np.iinfo(np.uint64).max)
    for at in range(0, len(found), 2048):
        low = np.minimum(low, (found[at:at + 2048, None] * _FACTOR + _SHIFT).min(0))
    return low


def band_values(low: np.ndarray) -> list[int]:
    """(bucket, order) of each band: a hash of the band's values, and 16 bits of each of the four that follow."""
    rows = low.reshape(BANDS, ROWS)
    bucket = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        bucket = (bucket ^ rows[:, k]) * _MIX
        bucket ^= bucket >> np.uint64(31)
    after = np.roll(low * _MIX >> np.uint64(48), -ROWS)
    following = np.lib.stride_tricks.sliding_window_view(np.append(after, after[:3]), 4)[::ROWS][:BANDS]
    order = following @ np.array([1 << 48, 1 << 32, 1 << 16, 1], np.uint64)
    return np.stack([bucket, order], 1).view(np.int64).ravel().tolist()


def one_bit_sketch(low: np.ndarray) -> tuple[int, int]:
    bits = np.packbits((low * _MIX >> np.uint64(63)).astype(bool))
    whole = np.zeros(16, np.uint8)
    whole[:len(bits)] = bits
    return tuple(whole.view(np.int64).tolist())


def text_hash(text):
    """64-bit hash that tells apart the texts under one id."""
    return F.xxhash64(text.cast("string"))


def with_signatures(df: DataFrame, id_col: str, text_col: str, words_in_shingle: int = SHINGLE_WORDS, sketch=None) -> DataFrame:
    """(doc_id, hash, key, size, s1, s2, bands) of each row; ``sketch(text)`` may give other 64 or 128 bits to compare."""
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                keys, sizes, first, second, bands = [], [], [], [], []
                for text in part.column(2):
                    raw = bytes(text.as_buffer()) if text.is_valid else b""
                    found = shingles(raw, words_in_shingle)
                    low = signature(found)
                    s = sketch(raw) if sketch else one_bit_sketch(low)
                    keys.append(set_key(found)), sizes.append(len(found)), first.append(s[0]), second.append(s[1]), bands.append(band_values(low))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *[pa.array(c, pa.int64()) for c in (keys, sizes, first, second)],
                                                  pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "hash", "key", "size", "s1", "s2", "bands"])

    text = col(text_col).cast("string")
    rows = df.select(col(id_col).alias("doc_id"), text_hash(col(text_col)).alias("hash"), F.coalesce(text, F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"doc_id {df.schema[id_col].dataType.simpleString()}, hash bigint, key bigint, size bigint, s1 bigint, s2 bigint, bands array<bigint>")


def _neighbours(radius: int, least: tuple[int, int], tile: int):
    """Candidates (a, b, bits) in batches sorted by (band, bucket, order, key): the two nearest of the rows before, and the bucket's head."""
    num, den = least

    def run(batches):
        tail = None                         # the last rows of the batch before
        head = None                         # the head of the bucket that it ends in
        for batch in batches:
            if not batch.num_rows:
                continue
            own = np.stack([batch.column(k).to_numpy() for k in range(6)])          # band, bucket, key, size, s1, s2
            rows = own if tail is None else np.concatenate([tail, own], 1)
            start = rows.shape[1] - own.shape[1]
            n = own.shape[1]
            # The nearest and the second nearest so far: (bits, place).
            best = [np.full(n, 129, np.int64), np.full(n, -1)]
            second = [np.full(n, 129, np.int64), np.full(n, -1)]

            def compare(left):
                """Bits between the batch's rows and ``left``, 129 where they can't be near copies."""
                right = rows[:, start:]
                # Of unsigned numbers: numpy counts the bits of an absolute value.
                differ = sum(np.bitwise_count((left[k] ^ right[k]).view(np.uint64)).astype(np.int64) for k in (4, 5))
                small, large = np.minimum(left[3], right[3]), np.maximum(left[3], right[3])
                fits = (left[0] == right[0]) & (left[1] == right[1]) & (left[2] != right[2]) & (small * den >= large * num) & (differ <= radius)
                return np.where(fits, differ, 129)

            for back in range(1, tile + 1):
                at = np.arange(start, start + n) - back
                found = np.where(at >= 0, compare(rows[:, np.maximum(at, 0)]), 129)
                if not ((at >= 0) & (rows[1, np.maximum(at, 0)] == rows[1, start:])).any():
                    break
                better, good = found < best[0], found < second[0]
                second = [np.where(better, b, np.where(good, f, s)) for b, f, s in zip(best, (found, at), second)]
                best = [np.where(better, f, b) for b, f in zip(best, (found, at))]
            new = np.append(True, (rows[:2, 1:] != rows[:2, :-1]).any(0))
            first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))[start:]
            heads = rows[:, first]
            if head is not None:
                same = (own[0] == head[0]) & (own[1] == head[1])
                heads = np.where(same, head[:, None], heads)
            to_head = compare(heads)
            head = heads[:, -1]
            tail = rows[:, -tile:]
            found = []
            for bits, others in ((best[0], rows[2, best[1]]), (second[0], rows[2, second[1]]), (to_head, heads[2])):
                near = np.flatnonzero(bits <= radius)
                found.append((others[near], own[2, near], bits[near]))
            a, b, bits = (np.concatenate(c) for c in zip(*found))
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(bits)], ["a", "b", "bits"])

    return run


def candidates(points: DataFrame, radius: int = RADIUS, least: tuple[int, int] = LEAST, tile: int = TILE) -> DataFrame:
    """(a, b, bits) of keys that may be near copies, from distinct (key, size, s1, s2, bands)."""
    band = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.struct(F.get("bands", 2 * b).alias("bucket"), F.get("bands", 2 * b + 1).alias("order"))))
    rows = points.select("key", "size", "s1", "s2", band.alias("band", "at")).select(F.col("band").cast("bigint").alias("band"), "at.bucket", "at.order", "key", "size", "s1", "s2")
    order = ["band", "bucket", "order", "key"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("order")
    return rows.mapInArrow(_neighbours(radius, least, tile), "a bigint, b bigint, bits bigint").groupBy("a", "b").agg(F.min("bits").alias("bits"))


def verified(pairs: DataFrame, texts: DataFrame, hashes: DataFrame, least: tuple[int, int] = LEAST, words_in_shingle: int = SHINGLE_WORDS) -> DataFrame:
    """The pairs (a, b) of keys whose whole sets are similar enough; ``texts`` is (hash, text), ``hashes`` names one text for each key.

    A filter of hash bits, of fixed size, keeps out most texts that no pair needs before their sets are made.
    """
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct().join(hashes, "key")
    mask = (1 << FILTER_BITS) - 1
    place = F.col("hash").bitwiseAND(F.lit(mask)) + 1
    found = wanted.groupBy(F.bitmap_bucket_number(place).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()
    bits = np.zeros((mask + 1) // 8, np.uint8)
    for row in found:
        bits[(row["part"] - 1) * 4096:row["part"] * 4096] = np.frombuffer(bytes(row["bits"]), np.uint8)
    needed = texts.sparkSession.sparkContext.broadcast(bits)

    def sets(batches):
        for batch in batches:
            low = batch.column(0).to_numpy() & mask
            rows = np.flatnonzero(needed.value[low >> 3] >> (low & 7) & 1)
            for part in np.split(rows, range(SLICE, len(rows), SLICE)):
                known = [shingles(batch.column(1)[int(i)].as_py(), words_in_shingle) for i in part]
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, known)]), pa.int32()),
                                                 pa.array(np.concatenate([*known, np.empty(0, np.uint64)]).view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array([set_key(x) for x in known], pa.int64()), lists], ["key", "found"])

    num, den = least
    made = write_table(texts.mapInArrow(sets, "key bigint, found array<bigint>").dropDuplicates(["key"]))
    rows = (pairs.select("a", "b").join(made.select(F.col("key").alias("a"), F.col("found").alias("x")), "a")
            .join(made.select(F.col("key").alias("b"), F.col("found").alias("y")), "b"))
    both = F.size(F.array_intersect("x", "y"))
    return rows.where(both * den >= num * (F.size("x") + F.size("y") - both)).select("a", "b")


def linked(docs: DataFrame, texts: DataFrame, radius: int = RADIUS, least: tuple[int, int] = LEAST, words_in_shingle: int = SHINGLE_WORDS,
           further=None) -> DataFrame:
    """(node, root) for the keys in ``docs`` (a written table of signatures) that verified links connect.

    ``further(points)`` may give candidates (a, b, bits) beside those of the bands.
    """
    kept = ["size", "s1", "s2", "bands", "hash"]
    points = write_table(docs.groupBy("key").agg(*[F.first(c).alias(c) for c in kept]))
    hashes = points.select("key", "hash")
    pairs = candidates(points, radius, least)
    if further is not None:
        pairs = pairs.unionByName(further(points)).groupBy("a", "b").agg(F.min("bits").alias("bits"))
    pairs = write_table(pairs)
    ends = pairs.select(F.col("a").alias("node"), F.struct("bits", F.col("b").alias("other")).alias("to")).unionAll(
        pairs.select(F.col("b").alias("node"), F.struct("bits", F.col("a").alias("other")).alias("to")))
    best = write_table(ends.groupBy("node").agg(F.min("to").alias("to"))
                       .select(F.least("node", "to.other").alias("a"), F.greatest("node", "to.other").alias("b")).distinct())
    links = write_table(verified(best, texts, hashes, least, words_in_shingle))
    roots = components(links)
    root = lambda side: roots.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}"))
    # A pair inside a group would change nothing; the others may still join two.
    rest = (pairs.select("a", "b").join(best, ["a", "b"], "left_anti").join(root("a"), "a", "left").join(root("b"), "b", "left")
            .where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b"))
    rest = write_table(rest)
    if rest.isEmpty():
        return roots
    return components(links.unionAll(verified(rest, texts, hashes, least, words_in_shingle)))


def near_text_groups(df: DataFrame, id_col: str, text_col: str, least: tuple[int, int] = LEAST, words_in_shingle: int = SHINGLE_WORDS) -> DataFrame:
    """One row for each input row: ``id_col, group_id`` (smallest id of its group), ``group_rows``.

    Rows belong together if links between near copies connect them.  Null text counts as empty; texts without words are alike; rows
    with equal texts are one group.  Null ids never name a group unless it has only such.  Approximate in one way:
    a link of similarity s is seen with probability ``expected_recall(s)``, over 0.999 at 0.8.
    """
    docs = write_table(with_signatures(df, id_col, text_col, words_in_shingle))
    texts = df.select(text_hash(col(text_col)).alias("hash"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"))
    roots = linked(docs, texts, least=least, words_in_shingle=words_in_shingle)
    rows = docs.select("doc_id", "key").join(roots, docs["key"] == roots["node"], "left").select("doc_id", F.coalesce("root", "key").alias("root"))
    groups = rows.groupBy("root").agg(F.min("doc_id").alias("group_id"), F.count(F.lit(1)).alias("group_rows"))
    return rows.join(groups, "root").select(F.col("doc_id").alias(id_col), "group_id", "group_rows")


ship_with_tasks(__name__)
