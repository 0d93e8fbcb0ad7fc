"""Near-duplicate names: word order and small typing differences ignored.

Two values are compared through their sorted lower-cased words.  The score is
``round(100 * 2 * LCS / (len_a + len_b))``, half to even.  A score of at
least t means at most ``(201 - 2 t) / 200`` of the joint length is inserted
or deleted; every step below is an exact consequence of that bound, so no
qualifying pair is lost and no pair of the whole table is ever enumerated.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..config import DEFAULT, NEAR_DUPLICATE_WORDS, Config
from ..functions import token_sort_key
from ..functions.lcs import lcs_lengths
from ..session import cut_lineage, ship_with_tasks, write_table
from .rows import ROW_ID, col, string_columns, with_dense_index
from .text_lsh import near_text_groups

ship_with_tasks(__name__)

MAX_DELETIONS = 2          # short branch: variants with up to this many deletions
HASH_BUCKETS = 4096        # gram frequency table, fixed size
GROUP_ROWS = 20_000        # salt gram groups expected to exceed this


def allowed_edits(total: int, threshold: int) -> int:
    """Most insertions plus deletions two strings of joint length total may need."""
    slack = total * (201 - 2 * threshold)
    # An exact half rounds to the even neighbour.
    return (slack if threshold % 2 == 0 else slack - 1) // 200


def longest_partner(length: int, threshold: int) -> int:
    """Longest string that can still match one of the given length."""
    other = length
    while other + 1 - length <= allowed_edits(length + other + 1, threshold):
        other += 1
    return other


def _deletions(length: int, partner: int, threshold: int) -> int | None:
    """Characters to delete from `length` to reach the shortest needed overlap."""
    k = allowed_edits(length + partner, threshold)
    if abs(length - partner) > k:
        return None
    return length - (length + partner - k + 1) // 2


def _variants(text: Column, deletions: int) -> Column:
    """Distinct results of deleting exactly that many characters."""
    n = F.length(text)
    if deletions == 0:
        return F.array(text)
    cut = lambda i, j: F.substr(text, i, j - i)
    tail = lambda i: F.substr(text, i)
    if deletions == 1:
        out = F.transform(F.sequence(F.lit(1), n),
                          lambda i: F.concat(cut(F.lit(1), i), tail(i + 1)))
    else:
        out = F.flatten(F.transform(
            F.sequence(F.lit(1), n - 1),
            lambda i: F.transform(F.sequence(i + 1, n),
                                  lambda j: F.concat(cut(F.lit(1), i), cut(i + 1, j), tail(j + 1)))))
    return F.array_distinct(out)


def _short_limit(lengths: list[int], threshold: int) -> int:
    """Largest length up to which pairs need few deletions on either side.

    Deletions grow with the lengths, so a key's longest partner and its
    shortest one decide; once a length needs too many, all longer ones do.
    """
    limit = 0
    for top in sorted(set(lengths)):
        low = top
        while low > 1 and _deletions(low - 1, top, threshold) is not None:
            low -= 1
        needed = [d for a in lengths if low <= a <= top for pair in ((a, top), (top, a))
                  for d in (_deletions(*pair, threshold),) if d is not None]
        if needed and max(needed) > MAX_DELETIONS:
            break
        limit = top
    return limit


def _shuffled(df: DataFrame) -> DataFrame:
    """A side of a join that is never broadcast.

    Spark judges keys by the size of the Parquet files behind them and counts nothing for what is exploded from them,
    so it would collect far larger tables in the driver than its limit tells.
    """
    return df.hint("merge")


def _subsequences(keys: DataFrame, lengths: list[int], limit: int, threshold: int) -> DataFrame:
    """(columns of keys, z, size): each key up to the length limit with the subsequences that a partner of it may share."""
    lengths = [n for n in lengths if n <= limit]
    size = F.length("key")
    depth = {n: max((d for m in lengths for d in (_deletions(n, m, threshold),) if d is not None),
                    default=-1) for n in lengths}
    none = F.array().cast("array<string>")
    variants = F.concat(*[
        F.when(size.isin([n for n in lengths if depth[n] >= d]), _variants(F.col("key"), d)).otherwise(none)
        for d in range(max(depth.values()) + 1)])
    return keys.filter(size <= limit).select("*", F.explode(variants).alias("z")).withColumn("size", F.length("key"))


def _enough(shared: Column, total: Column, threshold: int) -> Column:
    """Whether a subsequence of that length makes two strings of that joint length alike."""
    bound = (2 * threshold - 1) * total
    return 400 * shared > bound if threshold % 2 else 400 * shared >= bound


def _short_pairs(keys: DataFrame, lengths: list[int], limit: int, threshold: int) -> DataFrame:
    """Pairs up to the length limit, joined on a common subsequence.

    Every joined pair that passes the length test is a result, so the join is
    as large as its output and frequent words cost nothing.  The longest
    shared subsequence is the LCS itself.
    """
    emitted = _subsequences(keys.select("key"), lengths, limit, threshold)
    a = emitted.select("z", F.col("key").alias("key_a"), F.col("size").alias("la"))
    b = emitted.select("z", F.col("key").alias("key_b"), F.col("size").alias("lb"))
    enough = _enough(F.length("z"), F.col("la") + F.col("lb"), threshold)
    joined = a.join(_shuffled(b), "z").filter((F.col("key_a") < F.col("key_b")) & enough)
    return (joined.groupBy("key_a", "key_b").agg(F.max(F.length("z")).alias("lcs")))


@F.pandas_udf(T.IntegerType())
def _lcs_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(lcs_lengths(a, b))


def _chunk_size(low: int, high: int, threshold: int) -> int:
    """Largest chunk that leaves one more chunk than edits for every length.

    A key of length n needs at most r n edits, so its chunk is no shorter
    than n / (r n + 1) rounded down, which grows with n: once that reaches
    the smallest chunk so far, no longer key changes it.
    """
    r = 2 * (201 - 2 * threshold) / (2 * threshold - 1)
    q = None
    for n in range(low, high + 1):
        chunk = n // (allowed_edits(n + longest_partner(n, threshold), threshold) + 1)
        q = chunk if q is None else min(q, chunk)
        if int(n / (r * n + 1)) >= q:
            break
    return max(1, q)


def _long_pairs(keys: DataFrame, limit: int, longest: int, threshold: int) -> DataFrame:
    """Pairs whose longer side exceeds the limit, joined on an intact chunk.

    With at most k edits one of any k + 1 disjoint chunks of the shorter
    string survives in the longer one, shifted by at most k.  The k + 1 chunks
    are the rarest of the string, by a frequency table of fixed size, so
    common words are joined on only when a string has nothing else; groups
    that remain large are cut into a grid by salting both sides.
    """
    ratio = (400 - (2 * threshold - 1)) / (2 * threshold - 1)
    low = limit + 1
    while low > 1 and longest_partner(low - 1, threshold) > limit:
        low -= 1
    q = _chunk_size(low, longest, threshold)
    size = F.length("key")
    # An id stands for the key, so that a long key is not repeated in each of
    # its grams; texts return for the candidates only.
    pool = keys.filter(size >= low).select("key", size.alias("size"), F.xxhash64("key").alias("id"))
    band = F.floor(F.log(F.col("size").cast("double")) / F.lit(math.log(ratio) + 1e-9)).cast("int")

    gram_bucket = lambda g: F.pmod(F.xxhash64(g), F.lit(HASH_BUCKETS)).cast("int")
    grams = pool.filter(F.col("size") > limit).select(
        "id", "size", band.alias("band"),
        F.explode(F.transform(F.sequence(F.lit(1), F.col("size") - (q - 1)),
                              lambda i: F.struct(i.alias("at"),
                                                 F.substr("key", i, F.lit(q)).alias("gram")))).alias("g"))
    grams = grams.select("id", "size", "band", "g.at", "g.gram")
    freq = [0] * HASH_BUCKETS
    for r in grams.groupBy(gram_bucket(F.col("gram")).alias("h")).agg(F.count(F.lit(1)).alias("n")).collect():
        freq[r["h"]] = r["n"]
    table = F.split(F.lit(",".join(map(str, freq))), ",").cast("array<bigint>")
    count_of = lambda g: F.element_at(table, gram_bucket(g) + 1)
    salts = lambda g: F.ceil(F.sqrt(F.greatest(count_of(g) / F.lit(GROUP_ROWS), F.lit(1.0)))).cast("int")
    own = lambda k, g: F.pmod(F.xxhash64(k), salts(g)).cast("int")

    edits = F.lit(0)
    # Edits allowed against the longest partner, from integer arithmetic.
    partner = F.floor(F.col("size") * F.lit(ratio) + 1e-9).cast("int")
    edits = F.floor((F.col("size") + partner) * F.lit(201 - 2 * threshold) / 200).cast("int")
    chunks = F.slice(F.array_sort(F.transform(
        F.sequence(F.lit(0), F.floor(F.col("size") / q).cast("int") - 1),
        lambda i: F.struct(count_of(F.substr("key", i * q + 1, F.lit(q))).alias("n"),
                           (i * q + 1).alias("at"),
                           F.substr("key", i * q + 1, F.lit(q)).alias("gram")))),
        F.lit(1), edits + 1)
    left = (pool.select(F.col("id").alias("id_a"), F.col("size").alias("la"), band.alias("band"),
                        F.explode(chunks).alias("c"))
            .select("id_a", "la", F.col("c.at").alias("at_a"), F.col("c.gram").alias("gram"),
                    F.explode(F.array(F.col("band"), F.col("band") + 1)).alias("band"))
            .withColumn("row_salt", own(F.col("id_a"), F.col("gram")))
            .withColumn("col_salt", F.explode(F.sequence(F.lit(0), salts(F.col("gram")) - 1))))
    right = (grams.select(F.col("id").alias("id_b"), F.col("size").alias("lb"), "band",
                          F.col("at").alias("at_b"), "gram")
             .withColumn("col_salt", own(F.col("id_b"), F.col("gram")))
             .withColumn("row_salt", F.explode(F.sequence(F.lit(0), salts(F.col("gram")) - 1))))
    total = F.col("la") + F.col("lb")
    k = F.floor(total * F.lit(201 - 2 * threshold) / 200)
    near = (((F.col("la") < F.col("lb")) | ((F.col("la") == F.col("lb")) & (F.col("id_a") < F.col("id_b"))))
            & (F.col("lb") - F.col("la") <= k) & (F.abs(F.col("at_a") - F.col("at_b")) <= k))
    met = left.join(_shuffled(right), ["gram", "band", "row_salt", "col_salt"]).filter(near).select("id_a", "id_b").distinct()
    texts = lambda side: _shuffled(pool.select(F.col("id").alias(f"id_{side}"), F.col("key").alias(f"text_{side}")))
    candidates = (met.join(texts("a"), "id_a").join(texts("b"), "id_b").filter("text_a <> text_b")
                  .select(F.least("text_a", "text_b").alias("key_a"), F.greatest("text_a", "text_b").alias("key_b"))
                  .distinct())
    scored = candidates.withColumn("lcs", _lcs_udf("key_a", "key_b"))
    bound = (2 * threshold - 1) * (F.length("key_a") + F.length("key_b"))
    return scored.filter((400 * F.col("lcs") >= bound) if threshold % 2 == 0 else (400 * F.col("lcs") > bound))


def similar_keys(keys: DataFrame, threshold: int = 92) -> DataFrame:
    """(key_a, key_b, score) for all distinct keys scoring at least threshold.

    ``keys`` holds distinct, non-empty comparison keys in column ``key``.
    """
    lengths, pairs = _key_lengths(keys), None
    if lengths:
        limit = _short_limit(lengths, threshold)
        if limit:
            pairs = _short_pairs(keys, lengths, limit, threshold)
        if lengths[-1] > limit:
            longer = _long_pairs(keys, limit, lengths[-1], threshold)
            pairs = longer if pairs is None else pairs.unionByName(longer)
    if pairs is None:
        return keys.sparkSession.createDataFrame([], "key_a string, key_b string, score int")
    total = F.length("key_a") + F.length("key_b")
    return pairs.select("key_a", "key_b", F.bround(200.0 * F.col("lcs") / total, 0).cast("int").alias("score"))


def name_columns(df: DataFrame, config: Config = DEFAULT) -> list[str]:
    return [c for c in string_columns(df) if config.has_role(c, NEAR_DUPLICATE_WORDS)]


def near_pairs(df: DataFrame, columns=None, config: Config = DEFAULT, k: int | None = None) -> DataFrame:
    """Pairs of different values scoring from the threshold up to 99.

    One row per pair of comparison keys: an example value of each, the score
    and how many rows hold each key, so repeated names are not multiplied out.
    Default columns: all name-like ones.  ``k`` keeps the best.
    """
    columns = name_columns(df, config) if columns is None else list(columns)
    parts = []
    for c in columns:
        keys = (df.filter(col(c).isNotNull()).groupBy(token_sort_key(col(c)).alias("key"))
                .agg(F.min(col(c)).alias("value"), F.count(F.lit(1)).alias("rows"))
                .filter("key <> ''"))
        keys = cut_lineage(keys)
        pairs = similar_keys(keys.select("key"), config.similarity_threshold).filter("score < 100")
        a = keys.select(F.col("key").alias("key_a"), F.col("value").alias("a"), F.col("rows").alias("rows_a"))
        b = keys.select(F.col("key").alias("key_b"), F.col("value").alias("b"), F.col("rows").alias("rows_b"))
        parts.append(pairs.join(_shuffled(a), "key_a").join(_shuffled(b), "key_b")
                     .select(F.lit(c).alias("column_name"), "a", "b", "score", "rows_a", "rows_b"))
    if not parts:
        return df.sparkSession.createDataFrame(
            [], "column_name string, a string, b string, score int, rows_a bigint, rows_b bigint")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    if k is not None:
        out = out.orderBy(F.col("score").desc(), "column_name", "a", "b").limit(k)
    return out


# --- position window --------------------------------------------------------

def _similar_in_window(keys: list[str], window: int, threshold: int, blanks: bool):
    """Matching positions (earlier, later) within the window, ordered by later.

    Length and letter counts bound the score from above and drop most pairs;
    each remaining pair of different keys is compared once.
    """
    n = len(keys)
    codes, uniques = pd.factorize(np.array(keys, dtype=object))
    uniques = list(uniques)
    length = np.array([len(u) for u in uniques], dtype=np.int64)
    bag = np.zeros((len(uniques), 64), dtype=np.int16)
    for u, text in enumerate(uniques):
        if text:
            at = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32) % 64
            bag[u] = np.bincount(at, minlength=64)
    blank = length == 0
    first, pair = [], []
    for offset in range(1, min(window, n)):
        a, b = codes[:-offset], codes[offset:]
        total = length[a] + length[b]
        keep = np.flatnonzero((400 * np.minimum(length[a], length[b]) >= (2 * threshold - 1) * total)
                              & (blanks | (~blank[a] & ~blank[b])))
        lo, hi = np.minimum(a[keep], b[keep]), np.maximum(a[keep], b[keep])
        first.append(np.stack([keep, keep + offset]).astype(np.int32))
        pair.append(lo.astype(np.int64) * len(uniques) + hi)
    if not first:
        return np.zeros((2, 0), dtype=np.int32)
    at, code = np.concatenate(first, axis=1), np.concatenate(pair)
    distinct, inverse = np.unique(code, return_inverse=True)
    x, y = distinct // len(uniques), distinct % len(uniques)
    total = length[x] + length[y]
    lcs = np.where(x == y, length[x], 0)
    other = np.flatnonzero(x != y)
    shared = np.concatenate([np.minimum(bag[x[o]], bag[y[o]]).sum(axis=1, dtype=np.int64)
                             for o in np.array_split(other, len(other) // 65536 + 1)])
    other = other[400 * shared >= (2 * threshold - 1) * total[other]]
    lcs[other] = lcs_lengths([uniques[i] for i in x[other]], [uniques[i] for i in y[other]])
    score = np.where(total == 0, 100, np.rint(200.0 * lcs / np.maximum(total, 1)))
    at = at[:, (score >= threshold)[inverse]]
    return at[:, np.argsort(at[1], kind="stable")]


def _settle_block(keys: list[str], start: int, given: np.ndarray | None, window: int, threshold: int,
                  blanks: bool, greedy: bool) -> np.ndarray:
    """Flags of the rows of one block.

    The first ``start`` rows precede the block.  ``given`` holds their last
    flags if known; otherwise they are worked out as if nothing came before.
    """
    n = len(keys)
    earlier, later = _similar_in_window(keys, window, threshold, blanks)
    flags = np.zeros(n, dtype=bool)
    if not greedy:
        flags[later] = True
        return flags
    begin = 0
    if given is not None:
        flags[start - len(given):start] = given
        begin = start
    bounds = np.searchsorted(later, np.arange(n + 1))
    for r in range(begin, n):
        lo, hi = bounds[r], bounds[r + 1]
        if lo < hi:
            flags[r] = not flags[earlier[lo:hi]].all()
    return flags


def window_flags(df: DataFrame, column: str, index: str, config: Config = DEFAULT,
                 block_rows: int = 16_384) -> DataFrame:
    """(index, flagged) for rows similar to an earlier row within the window.

    ``index`` is dense.  Rows are grouped into blocks of consecutive
    positions, each with the rows just before it, so every group has a fixed
    size whatever the values are.

    Mode ``any_earlier`` flags a row when any similar earlier row exists.
    Mode ``greedy`` ignores earlier rows that are flagged themselves, so a
    block depends on the flags at the end of the one before.  Blocks first run
    with flags worked out from a lead-in; a block whose assumption differs
    from what its predecessor found runs again with the found flags, until all
    agree.  Flags forget their start quickly, so few blocks run twice.
    """
    window, threshold, blanks = config.near_duplicate_window, config.similarity_threshold, config.blanks_match
    greedy = config.near_duplicate_mode == "greedy"
    reach = window - 1
    block_rows = max(block_rows, window)
    lead = min(block_rows, 16 * reach if greedy else reach)

    key = F.coalesce(token_sort_key(col(column)), F.lit(""))
    rows = df.select(F.col(index).cast("bigint").alias("idx"), key.alias("key"))
    block = F.floor(F.col("idx") / block_rows).cast("bigint")
    into_next = F.pmod(F.col("idx"), F.lit(block_rows)) >= block_rows - lead
    placed = rows.select("idx", "key", F.explode(
        F.when(into_next, F.array(block, block + 1)).otherwise(F.array(block))).alias("block"))
    schema = "block bigint, used binary, tail binary, flagged array<bigint>"

    def run(pdf: pd.DataFrame, given: np.ndarray | None) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        idx = pdf["idx"].to_numpy()
        number = int(pdf["block"].iloc[0])
        start = int(np.searchsorted(idx, number * block_rows))
        if start == len(idx):
            # Only lead-in rows: the table ends with the block before.
            return pd.DataFrame({"block": [], "used": [], "tail": [], "flagged": []}).astype(object)
        flags = _settle_block(pdf["key"].tolist(), start, given, window, threshold, blanks, greedy)
        back = min(reach, start)
        return pd.DataFrame({
            "block": [number], "used": [flags[start - back:start].astype(np.uint8).tobytes()],
            "tail": [flags[max(start, len(idx) - reach):].astype(np.uint8).tobytes()],
            "flagged": pd.Series([idx[start:][flags[start:]].tolist()], dtype=object)})

    def guess(pdf: pd.DataFrame) -> pd.DataFrame:
        return run(pdf, None)

    def rerun(pdf: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        return run(pdf, np.frombuffer(found["tail"].iloc[0], dtype=np.uint8).astype(bool))

    if greedy:
        placed = cut_lineage(placed)
    settled = cut_lineage(placed.groupBy("block").applyInPandas(guess, schema))
    while greedy:
        # One short row per block takes part in this comparison.
        before = settled.select((F.col("block") + 1).alias("block"), "tail")
        wrong = cut_lineage(settled.select("block", "used").join(before, "block")
                            .filter("used <> tail").select("block", "tail"))
        if wrong.isEmpty():
            break
        again = (placed.join(wrong.select("block"), "block", "left_semi").groupBy("block")
                 .cogroup(wrong.groupBy("block")).applyInPandas(rerun, schema))
        settled = cut_lineage(settled.join(wrong.select("block"), "block", "left_anti").unionByName(again))
    return settled.select(F.explode("flagged").alias(index), F.lit(True).alias("flagged"))


def _key_lengths(keys: DataFrame) -> list[int]:
    return sorted(r["n"] for r in keys.select(F.length("key").alias("n")).distinct().collect())


def first_alikes(df: DataFrame, column: str, row: str, config: Config = DEFAULT) -> DataFrame:
    """(key, first): the first row whose value is like the key, itself included.

    Short keys meet in their subsequences: each holds the smallest row for
    every length, so a key finds its first match without a pair being built and the join
    is as large as the number of subsequences.  Only longer keys are paired.
    """
    threshold = config.similarity_threshold
    keys = (df.select(F.coalesce(token_sort_key(col(column)), F.lit("")).alias("key"), F.col(row).alias("row"))
            .groupBy("key").agg(F.min("row").alias("first")))
    keys = cut_lineage(keys if config.blanks_match else keys.filter("key <> ''"))
    named = keys.filter("key <> ''")
    lengths, met = _key_lengths(named), None
    limit = _short_limit(lengths, threshold) if lengths else 0
    if limit:
        emitted = _subsequences(named, lengths, limit, threshold)
        low = (emitted.groupBy("z", "size").agg(F.min("first").alias("low"))
               .groupBy("z").agg(F.collect_list(F.struct("size", "low")).alias("lows")))
        fits = F.filter("lows", lambda x: _enough(F.length("z"), x["size"] + F.col("size"), threshold))
        met = emitted.join(_shuffled(low), "z").groupBy("key").agg(F.min(F.array_min(F.transform(fits, lambda x: x["low"]))).alias("met"))
    if lengths and lengths[-1] > limit:
        pairs = _long_pairs(named.select("key"), limit, lengths[-1], threshold)
        both = pairs.select("key_a", "key_b").unionAll(pairs.select("key_b", "key_a"))
        longer = (both.join(_shuffled(keys.withColumnRenamed("key", "key_b")), "key_b").groupBy(F.col("key_a").alias("key"))
                  .agg(F.min("first").alias("met")))
        met = longer if met is None else met.unionByName(longer).groupBy("key").agg(F.min("met").alias("met"))
    if met is None:
        return keys
    return keys.join(_shuffled(met), "key", "left").select("key", F.coalesce(F.least("first", "met"), "first").alias("first"))


def greedy_keys(df: DataFrame, column: str, row: str, config: Config = DEFAULT) -> DataFrame:
    """(key, first): the key's first row if that is kept, null if all rows of the key are flagged.

    Rows are taken in order and one is flagged if it is like an earlier row
    that is kept.  Rows of one key share their fate but for the first, so this is
    the first independent set, in row order, over the links between distinct keys.  In each round
    keys without an undecided earlier neighbour are kept and their neighbours
    flagged; a column with one value has no link and needs no round.
    """
    keys = (df.select(F.coalesce(token_sort_key(col(column)), F.lit("")).alias("key"), F.col(row).alias("row"))
            .groupBy("key").agg(F.min("row").alias("first")))
    keys = cut_lineage(keys if config.blanks_match else keys.filter("key <> ''"))
    pairs = similar_keys(keys.filter("key <> ''").select("key"), config.similarity_threshold)
    place = lambda side: _shuffled(keys.select(F.col("key").alias(f"key_{side}"), F.col("first").alias(side)))
    links = write_table(pairs.join(place("a"), "key_a").join(place("b"), "key_b")
                        .select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")))
    flagged = None
    while not links.isEmpty():
        kept = links.select("low").distinct().join(links.select(F.col("high").alias("low")), "low", "left_anti")
        gone = write_table(links.join(kept, "low").select("high").distinct())
        flagged = gone if flagged is None else flagged.unionAll(gone)
        # Links of flagged keys bind no one; those of kept ones have done so.
        links = write_table(links.join(gone, "high", "left_anti").join(gone.select(F.col("high").alias("low")), "low", "left_anti"))
    if flagged is None:
        return keys
    out = flagged.select(F.col("high").alias("first"), F.lit(True).alias("gone"))
    return keys.join(out, "first", "left").select("key", F.when(F.col("gone").isNull(), F.col("first")).alias("first"))


def flag_near_duplicates(df: DataFrame, config: Config = DEFAULT, columns=None) -> DataFrame:
    """Add the near-duplicate flag column if any row earns it.

    A row is flagged if one of its name-like columns (or of ``columns``) holds
    a value like that of an earlier row: any earlier row of the table, or with
    ``near_duplicate_window`` one of the rows just before.  Every value has one
    first row that is like it, so whole-table flags need a join with the
    distinct values only.
    """
    columns = name_columns(df, config) if columns is None else list(columns)
    if not columns:
        return df
    if config.near_duplicate_mode == "lsh":
        return _flag_near_texts(df, columns, config)
    if config.near_duplicate_window is None:
        row = ROW_ID if ROW_ID in df.columns else "_idx"
        placed = df if row == ROW_ID else with_dense_index(df, "_idx", None)
        flag, extra = F.lit(False), []
        greedy = config.near_duplicate_mode == "greedy"
        for i, c in enumerate(columns):
            firsts = (greedy_keys if greedy else first_alikes)(placed, c, row, config).withColumnsRenamed({"key": f"_key{i}", "first": f"_first{i}"})
            placed = placed.join(_shuffled(firsts), F.coalesce(token_sort_key(col(c)), F.lit("")) == F.col(f"_key{i}"), "left")
            first = F.col(f"_first{i}")
            later = F.coalesce(first < F.col(row), F.lit(False))
            # Greedy: a key without a kept row is flagged whole.
            flag = flag | (later | (F.col(f"_key{i}").isNotNull() & first.isNull()) if greedy else later)
            extra += [f"_key{i}", f"_first{i}"]
        flagged = cut_lineage(placed.withColumn(config.near_duplicate_column, flag).drop(*extra, "_idx"))
        return flagged if flagged.filter(col(config.near_duplicate_column)).head(1) else flagged.drop(config.near_duplicate_column)
    placed = with_dense_index(df, "_idx", ROW_ID if ROW_ID in df.columns else None)
    flags = None
    for c in columns:
        found = window_flags(placed, c, "_idx", config)
        flags = found if flags is None else flags.unionAll(found)
    flags = cut_lineage(flags.distinct())
    if flags.isEmpty():
        return placed.drop("_idx")
    return (placed.join(flags, "_idx", "left")
            .withColumn(config.near_duplicate_column, F.coalesce("flagged", F.lit(False)))
            .drop("_idx", "flagged"))


def _flag_near_texts(df: DataFrame, columns, config: Config) -> DataFrame:
    """Flags for long texts: a row is flagged if an earlier one is in its group of near copies (``text_lsh``)."""
    row = ROW_ID if ROW_ID in df.columns else "_idx"
    placed = df if row == ROW_ID else with_dense_index(df, "_idx", None)
    flag = F.lit(False)
    for i, c in enumerate(columns):
        groups = near_text_groups(placed, row, c).where(F.col("group_id") < F.col(row)).select(row, F.lit(True).alias(f"_later{i}"))
        placed = placed.join(groups, row, "left")
        flag = flag | F.coalesce(F.col(f"_later{i}"), F.lit(False))
    flagged = cut_lineage(placed.withColumn(config.near_duplicate_column, flag).drop(*[f"_later{i}" for i in range(len(columns))], "_idx"))
    return flagged if flagged.filter(col(config.near_duplicate_column)).head(1) else flagged.drop(config.near_duplicate_column)
