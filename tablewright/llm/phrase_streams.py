"""Collocations from count streams in prefix and suffix order.

Laid out as an external language-model estimator: n-gram counts are sorted streams.  In prefix order a phrase
stands right behind the phrase it extends to the right, in suffix order behind the one it extends to the left; each
stream is merge-joined with the next shorter one, which gives the counts of a phrase's first and last part, and the most
frequent extension on either side on the way back.  Neither counting nor joining builds a hash table of phrases: tasks
sort, and Spark merges sorted sides.

Counting takes two passes over the texts.  The first counts words and pairs.  The second counts longer phrases, and needs only those
whose parts all reached the least count, since no phrase is more frequent than its parts: a filter of fixed size says
which pairs may have.  A filter that is full lets everything pass, which changes the cost and never a count.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from .common import bit_filter, col, ship_with_tasks, write_table

LEAST, WORDS, TOP = 10, 3, 2000
SCALE = 1_000_000
#: A longer phrase that covers this many hundredths of a candidate's occurrences replaces it.
COVER = 50
NO_LANG = "und"
#: Bytes of text counted at once in a task, and bits of the filter of frequent pairs.
CHUNK, FILTER_BITS = 3 << 20, 25
_BREAK, _BLANK = 2, 1
#: Bytes that end a piece, and those that part words within one.
_KIND = np.zeros(256, np.uint8)
_KIND[list(b".,;:!?\n\x0b\x0c\r")] = _BREAK
_KIND[list(b" \t")] = _BLANK


def _tokens(texts: pa.Array, langs: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, pa.Array]:
    """(distinct words, each token's word, each token's piece, each token's language) of non-null texts."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32 if pa.types.is_string(texts.type) else np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(bytes(raw[int(offsets[0]):int(offsets[-1])]).lower() if raw is not None else b"", np.uint8)      # bytes.lower() knows A-Z only
    ends = (offsets[1:] - offsets[0]).astype(np.int64)
    kind = _KIND[data]
    inside = kind == 0
    # A word starts behind a separator and at the start of a text.
    starts_here = inside.copy()
    starts_here[1:] &= ~inside[:-1]
    at_text = np.append(0, ends[:-1])
    at_text = at_text[at_text < len(data)]
    starts_here[at_text] |= inside[at_text]
    starts = np.flatnonzero(starts_here)
    breaks = (kind == _BREAK).astype(np.int8)
    breaks[at_text] += 1
    piece = np.cumsum(breaks, dtype=np.int32)[starts]
    kept = np.cumsum(inside, dtype=np.int32)
    token_offsets = np.append(kept[starts] - 1, kept[-1:]).astype(np.int64) if len(starts) else np.zeros(1, np.int64)
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(token_offsets), pa.py_buffer(data[inside]))
    coded = words.dictionary_encode()
    lang = langs.take(pa.array(np.searchsorted(ends, starts, "right")))
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64), piece, lang


def _grams(word: np.ndarray, piece: np.ndarray, n: int) -> np.ndarray:
    """First tokens of the n-grams within pieces."""
    if len(word) < n:
        return np.empty(0, np.int64)
    return np.flatnonzero(piece[:len(piece) - n + 1] == piece[n - 1:])


def _ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of one occurrence of each distinct key, in order; rank of every key)."""
    order = np.argsort(keys, kind="stable")
    new = np.flatnonzero(np.append(True, keys[order][1:] != keys[order][:-1]))
    number = np.empty(len(keys), np.int64)
    number[order] = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(keys))))
    return order[new], number


def _hash(values: pa.Array) -> np.ndarray:
    """64-bit polynomial hashes of strings, for the filter only."""
    offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset:values.offset + len(values) + 1]
    data = np.frombuffer(values.buffers()[2], np.uint8) if values.buffers()[2] is not None else np.empty(0, np.uint8)
    length = np.diff(offsets)
    out = length.astype(np.uint64)
    for k in range(int(length.max(initial=0))):
        at = np.flatnonzero(length > k)
        if len(at) * 8 < len(length) and k > 64:
            break                                   # the rest of very long words doesn't matter to a filter
        out[at] = (out[at] ^ data[offsets[at] + k]) * np.uint64(0x100000001B3)
        out[at] ^= out[at] >> np.uint64(29)
    return out


def _bit(lang_hash: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    x = ((lang_hash * np.uint64(31) + first) * np.uint64(0x9E3779B97F4A7C15) ^ (second + np.uint64(0x632BE59BD9B4E019))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def _phrases(words: pa.Array, parts: list[np.ndarray]) -> pa.Array:
    return pc.binary_join_element_wise(*[words.take(pa.array(p)) for p in parts], pa.scalar(" ", pa.large_string())) if len(parts) > 1 else words.take(pa.array(parts[0]))


def _counted(table: pa.Table, orders: list[int], seen: np.ndarray | None):
    """(lang, words in the phrase, phrase, n) over a chunk of texts."""
    texts = pc.fill_null(table["text"].combine_chunks(), "")
    vocabulary, word, piece, lang = _tokens(texts, table["lang"].combine_chunks())
    langs = lang.dictionary_encode()
    lang_id = langs.indices.to_numpy().astype(np.int64)
    width = len(vocabulary) + 1
    if seen is not None and len(word):
        h, hl = _hash(vocabulary), _hash(langs.dictionary.cast(pa.large_string()))
    # Number the phrases of each order by sorting; a phrase of n words is one of n - 1 and a word.
    at, number = np.arange(len(word)), lang_id * width + word
    del lang, table, texts
    for n in range(1, max(orders) + 1):
        if n > 1:
            joined = _grams(word, piece, n)
            if seen is not None:
                # All pairs inside a longer phrase are frequent, or it isn't.
                ok = np.zeros(len(word), bool)
                pair = _grams(word, piece, 2)
                bit = _bit(hl[lang_id[pair]], h[word[pair]], h[word[pair + 1]])
                ok[pair] = seen[bit >> 3] >> (bit & 7) & 1
                joined = joined[np.logical_and.reduce([ok[joined + k] for k in range(n - 1)])]
            place = np.full(len(word), -1)
            place[at] = number
            at, number = joined, place[joined] * width + word[joined + n - 1]
        if not len(at):
            return
        one, number = _ranked(number)
        if n in orders:
            first = at[one]
            yield pa.RecordBatch.from_arrays(
                [langs.dictionary.take(pa.array(lang_id[first])).cast(pa.string()), pa.array(np.full(len(one), n, np.int32)),
                 _phrases(vocabulary, [word[first + k] for k in range(n)]).cast(pa.string()), pa.array(np.bincount(number, minlength=len(one)))],
                ["lang", "words", "phrase", "n"])


def _count(orders: list[int], shared=None):
    def run(batches):
        seen = None if shared is None else shared.value
        waiting, size = [], 0

        def slices(made):
            for batch in made:
                for i in range(0, batch.num_rows, 1 << 16):
                    yield batch.slice(i, 1 << 16)

        for batch in batches:
            # Spark's batches have a number of rows, not of bytes: cut them where a chunk is full.
            total = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            begin = 0
            while begin < batch.num_rows:
                before = total[begin - 1] if begin else 0
                end = max(begin + 1, int(np.searchsorted(total, before + CHUNK - size)))
                waiting.append(batch.slice(begin, end - begin))
                size += int(total[end - 1] - before)
                begin = end
                if size >= CHUNK or end < batch.num_rows:
                    yield from slices(_counted(pa.Table.from_batches(waiting), orders, seen))
                    waiting, size = [], 0
                    # Two workers share what an executor's heap leaves over.
                    pa.default_memory_pool().release_unused()
        if waiting:
            yield from slices(_counted(pa.Table.from_batches(waiting), orders, seen))

    return run


def _streams(rows: DataFrame, orders: list[int], shared=None) -> DataFrame:
    counts = rows.mapInArrow(_count(orders, shared), "lang string, words int, phrase string, n bigint")
    return counts.groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n"))


def _frequent_pairs(pairs: DataFrame) -> np.ndarray:
    """The filter of the frequent pairs: 2^25 bits whatever their number."""
    def bits(batches):
        found = []
        for batch in batches:
            lang, phrase = batch.column(0).cast(pa.large_string()), batch.column(1).cast(pa.large_string())
            if batch.num_rows:
                parts = pc.split_pattern(phrase, " ")
                first, second = pc.list_element(parts, 0), pc.list_element(parts, 1)
                found.append(np.unique(_bit(_hash(lang), _hash(first), _hash(second))))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(found)).astype(np.int32))], ["bit"])

    return bit_filter(pairs.select("lang", "phrase").mapInArrow(bits, "bit int"), FILTER_BITS)


def phrase_counts(df: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, words: int = WORDS) -> tuple[DataFrame, DataFrame]:
    """(lang, words, phrase, n) of every phrase up to ``words`` words that occurs ``least`` times or more in its language, and
    (lang, n) with the number of all word occurrences.

    Texts are lower-cased in A-Z, cut into pieces at ``. , ; : ! ?`` and line breaks, and those into words at space and tab.
    """
    rows = df.select(F.coalesce(col(lang_col).cast("string"), F.lit(NO_LANG)).alias("lang"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"))
    short = _streams(rows, [1, 2])
    short = write_table(short.where((F.col("words") == 1) | (F.col("n") >= least)))
    totals = short.where("words = 1").groupBy("lang").agg(F.sum("n").alias("n"))
    frequent = short.where(F.col("n") >= least)
    if words < 3:
        return frequent.where(F.col("words") <= words), totals
    shared = df.sparkSession.sparkContext.broadcast(_frequent_pairs(frequent.where("words = 2")))
    longer = _streams(rows, list(range(3, words + 1)), shared)
    return frequent.unionByName(write_table(longer.where(F.col("n") >= least))), totals


def _cut(n: int) -> Column:
    """floor(SCALE * a * a / (l * r)) in whole numbers of up to 38 digits."""
    a, l, r = (F.col(c).cast("decimal(15,0)") for c in ("a", f"l{n}", f"r{n}"))
    return F.call_function("div", (a * a).cast("decimal(30,0)") * F.lit(SCALE).cast("decimal(8,0)"), (l * r).cast("decimal(30,0)"))


def collocations(df: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, words: int = WORDS, top: int | None = TOP) -> DataFrame:
    """The highest-scoring phrases of 2 to ``words`` words of each language: ``lang, rank, phrase, a, l, r, n, score``.

    A phrase that occurs ``a`` times is cut where ``a * a / (l * r)`` is least, ``l`` and ``r`` being the counts of its parts.
    Phrases of which a longer one covers half or more of the occurrences are left out.

    Null text counts as empty, null language as ``und``; repeated rows count again; an empty table gives an empty result;
    further columns are ignored.  Ties in score go to the more frequent phrase, then to the first in UTF-8 byte order.
    """
    counts, totals = phrase_counts(df, lang_col, text_col, least, words)
    counts = write_table(counts)
    part = lambda lo, hi: F.array_join(F.slice(F.split("phrase", " "), lo, hi), " ")
    found, covered = [], []
    for n in range(2, words + 1):
        stream = counts.where(F.col("words") == n).select("lang", "phrase", F.col("n").alias("a"))
        for k in range(1, n):
            # Prefix order on the left, suffix order on the right; each side is sorted and merged.
            left = counts.where(F.col("words") == k).select("lang", F.col("phrase").alias("_first"), F.col("n").alias(f"l{k}"))
            right = counts.where(F.col("words") == n - k).select("lang", F.col("phrase").alias("_rest"), F.col("n").alias(f"r{k}"))
            stream = stream.withColumn("_first", part(1, k)).join(left.hint("merge"), ["lang", "_first"]).drop("_first")
            stream = stream.withColumn("_rest", part(k + 1, n - k)).join(right.hint("merge"), ["lang", "_rest"]).drop("_rest")
        best = F.array_min(F.array(*[F.struct(_cut(k).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")) for k in range(1, n)]))
        found.append(stream.withColumn("_best", best).select("lang", "phrase", "a", "_best.l", "_best.r", "_best.score"))
        for m in range(2, n):
            for k in range(1, n - m + 2):
                covered.append(counts.where(F.col("words") == n).select("lang", part(k, m).alias("phrase"), F.col("n").alias("longer")))
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    if covered:
        over = covered[0]
        for more in covered[1:]:
            over = over.unionByName(more)
        over = over.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
        rows = (rows.join(over.hint("merge"), ["lang", "phrase"], "left")
                .where(F.coalesce(F.col("longer").cast("decimal(20,0)") * 100 < F.col("a").cast("decimal(20,0)") * COVER, F.lit(True))).drop("longer"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.col("phrase"))
    rows = rows.withColumn("rank", F.row_number().over(order))
    if top is not None:
        rows = rows.where(F.col("rank") <= top)
    return rows.join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ship_with_tasks(__name__)
