"""Repeated byte strings by an interval tree over enhanced suffix arrays.

A repeat is maximal when its occurrences go on differently to the right and to the left.  In a sorted suffix array the first
is an interval of the common-prefix array, found by a scan with a stack; the second is a test of the bytes before the
interval's suffixes.  Every group comes with all of its occurrences, so it is known who has the passage first.

One suffix array of a whole corpus is cut up by content.  Every string of ``window`` bytes names an anchor in it, the place
of its smallest hash of a short gram, so equal strings name the same anchor at the same offset; the strings in a row that
name one anchor form a stretch of about 65 bytes.  All stretches of one gram are a bucket with a suffix array of its own; where a bucket
holds one stretch only, that is the repeat.

Buckets are range-sorted by gram, what follows it and what stands before it, so that one that half of the corpus shares is
dealt to many tasks.  A string that may go on in the neighbouring task, because the bucket is cut within its right part, is
settled by an aggregation over the few strings at such cuts; all others are settled where they lie.

Of equal texts only the first is searched; the others go as a whole.  Two fixed-size filters of hash bits keep out texts
without a copy and grams that occur, with their surroundings, in one document.  A full filter lets everything pass, which changes the cost and never the result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import bit_filter, col, ship_with_tasks, write_table

WINDOW = 50
#: Bytes handled at once in a task (its arrays take about a hundred times as many), and bits of a filter.
CHUNK, FILTER_BITS = 1 << 20, 27
#: Stands for a missing id, which comes after all others.
NO_ID = (1 << 63) - 1
_RANDOM = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_PLACE = np.uint64((1 << 24) - 1)


def _hashes(data: np.ndarray, *widths: int) -> list[np.ndarray]:
    """Hashes of the bytes from each position on, for several numbers of bytes, from hashes of powers of two of them."""
    power, factor, width = {1: _RANDOM[data]}, {1: _STEP}, 1
    while 2 * width <= max(widths):
        power[2 * width] = power[width][:-width] * factor[width] + power[width][width:]
        factor[2 * width] = np.uint64(int(factor[width]) ** 2 % (1 << 64))
        width *= 2
    found = []
    for size in widths:
        have = max(w for w in power if w <= size)
        out = power[have]
        while have < size:
            width = max(w for w in power if w <= size - have)
            n = max(0, len(data) - have - width + 1)
            out = out[:n] * factor[width] + power[width][have:have + n]
            have += width
        out = (out ^ out >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
        found.append(out ^ out >> np.uint64(29))
    return found


class Anchors:
    """The stretches of joined pieces: gram hash, anchor, start, end and piece of each, as arrays.

    A repeated string holds the gram and half of the rest at least on one side, so its anchor matters only if the gram repeats
    with that much before or behind it: ``sides`` are those two hashes, ``has`` tells where the piece is long enough.
    """

    def __init__(self, pieces: list[bytes], window: int):
        gram = _gram(window)
        more = (window - gram + 1) // 2
        self.data = data = np.frombuffer(b"".join(pieces), np.uint8)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(lengths)
        self.starts = ends - lengths
        self.gram, self.sides, self.has = np.empty(0, np.uint64), np.empty((2, 0), np.uint64), np.empty((2, 0), bool)
        self.anchor = self.start = self.end = self.piece = np.empty(0, np.int64)
        if not len(data) or lengths.max() < window:
            return
        hashes, wide = _hashes(data, gram, gram + more)
        # The leftmost smallest hash of each window; the place decides between equal ones.
        low, reach = hashes & ~_PLACE | np.arange(len(hashes), dtype=np.uint64), window - gram + 1
        width = 1
        while 2 * width <= reach:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if width < reach:
            low = np.minimum(low[:len(low) - (reach - width)], low[reach - width:])
        whole = np.zeros(len(data) + 1, np.int32)
        fits = lengths >= window
        np.add.at(whole, self.starts[fits], 1)
        np.add.at(whole, ends[fits] - window + 1, -1)
        at = np.flatnonzero(np.cumsum(whole)[:len(low)])
        anchor = (low[at] & _PLACE).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)]))
        self.anchor, self.start, self.end = anchor[new], at[new], at[np.append(new[1:], len(at)) - 1] + window
        self.gram, self.piece = hashes[self.anchor], np.searchsorted(ends, self.start, "right")
        before = self.anchor - more
        self.has = np.stack([before >= self.starts[self.piece], self.anchor + gram + more <= ends[self.piece]])
        last = len(wide) - 1
        self.sides = np.stack([wide[np.clip(before, 0, last)] ^ _STEP, wide[np.minimum(self.anchor, last)]])

    def __len__(self) -> int:
        return len(self.gram)


def _gram(window: int) -> int:
    return max(1, window * 2 // 5)


def _chunks(batches, window: int, skip=None):
    """(texts joined by piece, row of each piece, its place in the row's text, batch): texts longer than a chunk are cut, and
    pieces overlap so that no string of ``window`` bytes is lost.  ``skip`` is a filter of texts to leave out."""
    for batch in batches:
        pieces, rows, places, size = [], [], [], 0
        out = _passes(skip.value, batch.column(1).to_numpy().view(np.uint64)) if skip is not None else np.zeros(batch.num_rows, bool)
        for i, text in enumerate(batch.column(2)):
            raw = memoryview(text.as_buffer()) if text.is_valid and not out[i] else b""
            for at in range(0, max(0, len(raw) - window + 1), CHUNK):
                piece = bytes(raw[at:at + CHUNK + window - 1])
                pieces.append(piece), rows.append(i), places.append(at)
                size += len(piece)
                if size >= CHUNK:
                    yield pieces, np.array(rows), np.array(places), batch
                    pieces, rows, places, size = [], [], [], 0
        if pieces:
            yield pieces, np.array(rows), np.array(places), batch


#: Leading bits of a hash that give its two places in a filter: the first and the last FILTER_BITS of them.
KNOWN_BITS = 38


def _bits(hashes: np.ndarray) -> np.ndarray:
    known = hashes >> np.uint64(64 - KNOWN_BITS)
    return np.stack([known >> np.uint64(KNOWN_BITS - FILTER_BITS), known & np.uint64((1 << FILTER_BITS) - 1)]).astype(np.int64)


def _passes(known: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    bits = _bits(hashes)
    return (known[bits >> 3] >> (bits & 7) & 1).all(0)


class Texts:
    """What is searched: texts without a copy where they lie, and the first of each group of equal ones as a table."""

    def __init__(self, df: DataFrame, id_col: str, text_col: str):
        spark = df.sparkSession
        text = col(text_col).cast("string")
        self.all = df.select(F.coalesce(col(id_col).cast("bigint"), F.lit(NO_ID)).alias("doc"), F.xxhash64(text).alias("hash"), F.coalesce(text, F.lit("")).alias("text"))
        # A second hash beside the first: a group is a group of equal texts.
        narrow = self.all.select("doc", "hash", F.xxhash64(F.lit(1), "text").alias("more"), F.octet_length("text").cast("bigint").alias("n"))
        groups = write_table(narrow.groupBy("hash", "more").agg(F.min("doc").alias("first"), F.count(F.lit(1)).alias("rows")).where("rows > 1"))
        self.copies = (narrow.join(groups, ["hash", "more"]).where("doc > first")
                       .select("doc", "hash", F.lit(0).cast("bigint").alias("start"), F.col("n").alias("end")))
        known = F.shiftrightunsigned("hash", 64 - KNOWN_BITS)
        both = F.array(F.shiftright(known, KNOWN_BITS - FILTER_BITS), known.bitwiseAND(F.lit((1 << FILTER_BITS) - 1).cast("bigint")))
        self.skip = spark.sparkContext.broadcast(bit_filter(groups.select(F.explode(both).alias("bit")), FILTER_BITS))
        skip = self.skip

        def repeated(batches):
            for batch in batches:
                kept = batch.filter(pa.array(_passes(skip.value, batch.column(1).to_numpy().view(np.uint64))))
                for i in range(0, kept.num_rows, 256):
                    yield kept.slice(i, 256)

        own = self.all.mapInArrow(repeated, "doc bigint, hash bigint, text string").withColumn("more", F.xxhash64(F.lit(1), "text"))
        # Texts that pass a filled filter though they have no copy are in no group: they come back as they are.
        joined = own.join(groups.select("hash", "more", "first"), ["hash", "more"], "left").where("first is null or first = doc")
        self.firsts = write_table(joined.dropDuplicates(["doc", "hash", "more"]).select("doc", "hash", "text"))

    def scan(self, task, schema: str) -> DataFrame:
        """``task(skip)`` over all texts that are searched."""
        return self.all.mapInArrow(task(self.skip), schema).unionAll(self.firsts.mapInArrow(task(None), schema))


def repeated_grams(texts: Texts, window: int) -> np.ndarray:
    """The filter of the anchors' grams that occur in two documents or more, with what stands on one side of them.  32 bits of each
    hash are sent, dealt by the bits above."""
    spark = texts.all.sparkSession
    parts_log = min(11, max(KNOWN_BITS - 32, (8 * int(spark.conf.get("spark.sql.shuffle.partitions"))).bit_length()))
    low = np.uint64(20)

    def deal(skip):
        def run(batches):
            for pieces, _, _, _ in _chunks(batches, window, skip):
                found = Anchors(pieces, window)
                hashes, piece = found.sides[found.has], np.broadcast_to(found.piece, found.has.shape)[found.has]
                # Once for each piece: 20 bits for its number are left below the hash.
                once = np.unique(hashes >> np.uint64(32 - parts_log) << low | piece.astype(np.uint64) & np.uint64((1 << 20) - 1))
                hashes, n = np.unique(once >> low, return_counts=True)
                part, rest = hashes >> np.uint64(32), hashes.astype(np.uint32)
                cuts = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.empty(0, np.int64)
                # Two of a kind are enough to know that it repeats.
                blocks = [np.repeat(r, c).tobytes() for r, c in zip(np.split(rest, cuts[1:]), np.split(np.minimum(n, 2), cuts[1:]))]
                if len(cuts):
                    yield pa.RecordBatch.from_arrays([pa.array(part[cuts].astype(np.int32)), pa.array(blocks, pa.binary())], ["part", "block"])

        return run

    def count(batches):
        part, blocks = None, []

        def done():
            found, n = np.unique(np.concatenate(blocks), return_counts=True)
            whole = (np.uint64(part) << np.uint64(32) | found[n > 1].astype(np.uint64)) << np.uint64(32 - parts_log)
            return pa.RecordBatch.from_arrays([pa.array(np.unique(_bits(whole)))], ["bit"])

        for batch in batches:
            for i, block in zip(batch.column(0).to_pylist(), batch.column(1)):
                if i != part:
                    if blocks:
                        yield done()
                    part, blocks = i, []
                blocks.append(np.frombuffer(block.as_buffer(), np.uint32).copy())
        if blocks:
            yield done()

    dealt = texts.scan(deal, "part int, block binary").repartition("part").sortWithinPartitions("part")
    return bit_filter(dealt.mapInArrow(count, "bit bigint"), FILTER_BITS)


def _slices(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    lengths = end - begin
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    index = np.repeat(begin - offsets[:-1], lengths) + np.arange(offsets[-1])
    return pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data[index])])


STRETCH = "gram bigint, right binary, left binary, doc bigint, hash bigint, anchor bigint"


def stretches(texts: Texts, window: int, known) -> DataFrame:
    """(gram, right, left, doc, hash, anchor): what stands behind and before each anchor whose gram may repeat."""
    size = _gram(window)

    def task(skip):
        def run(batches):
            for pieces, rows, places, batch in _chunks(batches, window, skip):
                found = Anchors(pieces, window)
                at = np.flatnonzero((np.stack([_passes(known.value, side) for side in found.sides]) & found.has).any(0)) if len(found) else found.anchor
                place = found.anchor - found.starts[found.piece] + places[found.piece]
                for part in np.split(at, range(1 << 15, len(at), 1 << 15)):
                    anchor, row = found.anchor[part], pa.array(rows[found.piece[part]])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(found.gram[part].view(np.int64)), _slices(found.data, anchor + size, found.end[part]), _slices(found.data, found.start[part], anchor),
                         batch.column(0).take(row), batch.column(1).take(row), pa.array(place[part])], ["gram", "right", "left", "doc", "hash", "anchor"])

        return run

    return texts.scan(task, STRETCH)


def _common(a: bytes, b: bytes, least: int = 0) -> int:
    """Length of the common prefix; 0 if below ``least``."""
    if a[:least] != b[:least]:
        return 0
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return next(i for i in range(least, n) if a[i] != b[i])


def maximal_repeats(strings: list[bytes], window: int):
    """Yield (length, [(string, place), ...]) of each maximal repeat of ``window`` bytes or more, with all its occurrences.

    The suffixes are sorted; a stack holds the open intervals of the common-prefix array, and one that ends is a repeat if the
    bytes before its suffixes differ or a string begins there.
    """
    suffixes = sorted((s[p:], i, p) for i, s in enumerate(strings) for p in range(len(s) - window + 1))
    stack: list[tuple[int, int]] = []
    for k in range(1, len(suffixes) + 1):
        length = _common(suffixes[k - 1][0], suffixes[k][0], window) if k < len(suffixes) else 0
        begin = k - 1
        while stack and stack[-1][0] > length:
            deep, begin = stack.pop()
            members = [(i, p) for _, i, p in suffixes[begin:k]]
            before = {strings[i][p - 1] if p else -1 for i, p in members}
            if len(before) > 1 or -1 in before:
                yield deep, members
        if length and (not stack or stack[-1][0] < length):
            stack.append((length, begin))


def least_documents(kinds: list[tuple[bytes, bytes, int]], window: int) -> list[list[int]]:
    """For each (right, left, smallest document) of a bucket the smallest document of each of its strings, from the left."""
    # Bytes that no text holds stand for the gram, so that strings are alike only at the same offset.
    size = _gram(window)
    least = [[low] * (len(left) + size + len(right) - window + 1) for right, left, low in kinds]
    for length, members in maximal_repeats([left + b"\xff" * size + right for right, left, _ in kinds], window) if len(kinds) > 1 else ():
        low = min(kinds[i][2] for i, _ in members)
        for i, p in members:
            own = least[i]
            for q in range(p, p + length - window + 1):
                if low < own[q]:
                    own[q] = low
    return least


class _Found:
    """Rows that a task returns: spans, and with their string those at a cut for which another task may hold a smaller document."""

    SCHEMA = "doc bigint, hash bigint, start bigint, end bigint, gram bigint, string binary"
    TYPES = [*[pa.int64()] * 5, pa.binary()]
    NAMES = [c.split()[0] for c in SCHEMA.split(", ")]

    def __init__(self):
        self.rows: list[tuple] = []

    def batch(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), self.TYPES)], self.NAMES)


def _spans(doc, hash_, start, end) -> pa.RecordBatch:
    columns = [doc, hash_, pa.array(start), pa.array(end), *[pa.nulls(len(doc), t) for t in _Found.TYPES[4:]]]
    return pa.RecordBatch.from_arrays(columns, _Found.NAMES)


def _scan(window: int):
    """Spans of repeats in rows sorted by (gram, right, left, doc); the buckets at both ends of a task may go on next door."""
    size = _gram(window)

    def bucket(table: pa.Table, first: bytes | None, last: bytes | None, out: _Found) -> None:
        gram = table["gram"][0].as_py()
        kinds, members = [], []
        for right, left, *place in zip(*[table[c].to_pylist() for c in ("right", "left", "doc", "hash", "anchor")]):
            if not kinds or kinds[-1][:2] != (right, left):
                kinds.append((right, left, place[0]))
                members.append([])
            members[-1].append(place)
        for (right, left, _), own, least in zip(kinds, members, least_documents(kinds, window)):
            # A smaller document here is enough, whatever other tasks hold.
            high, ranges = own[-1][0], {}
            for q, low in enumerate(least):
                if low < high:
                    ranges[low] = (ranges.get(low, (q,))[0], q + window)
            # Strings of one stretch overlap, so those of one document and all between them are one span.
            for low, (begin, end) in ranges.items():
                out.rows.extend((doc, hash_, anchor + begin - len(left), anchor + end - len(left), None, None) for doc, hash_, anchor in own if doc > low)
            shared = max((_common(right, edge) for edge in (first, last) if edge is not None), default=-1)
            # The string at q has window - size - (len(left) - q) bytes of the right part: those that may go on elsewhere come first.
            whole = left + b"\xff" * size + right
            for q in range(max(0, min(len(least), shared - window + size + len(left) + 1)) if shared >= 0 else 0):
                out.rows.extend((doc, hash_, anchor + q - len(left), anchor + q - len(left) + window, gram, whole[q:q + window])
                                for doc, hash_, anchor in own if doc == least[q])

    def run(batches):
        out, carry, first = _Found(), None, True

        def settle(table: pa.Table, done: bool):
            """The buckets of a table, but for the last one unless no more rows come."""
            nonlocal carry, first
            grams = table["gram"].to_numpy()
            edges = np.concatenate([[0], np.flatnonzero(grams[1:] != grams[:-1]) + 1, [len(grams)]])
            carry = None if done else table.slice(edges[-2])
            begin = 0 if done or len(edges) > 2 else None
            if begin is None:
                return
            low, high = list(edges[:-1]), list(edges[1:])
            if not done:
                low, high = low[:-1], high[:-1]
            if first:
                last = table["right"][int(high[0]) - 1].as_py() if done and len(low) == 1 else None
                bucket(table.slice(low[0], high[0] - low[0]), table["right"][0].as_py(), last, out)
                first, low, high = False, low[1:], high[1:]
            if done and low:
                bucket(table.slice(low[-1], high[-1] - low[-1]), None, table["right"][len(table) - 1].as_py(), out)
                low, high = low[:-1], high[:-1]
            if not low:
                return
            # Buckets of one document have nothing; those of one stretch are settled side by side.
            inner = table.slice(low[0], high[-1] - low[0]).combine_chunks()
            doc = inner["doc"].to_numpy()
            low, high = np.array(low) - low[0], np.array(high) - low[0]
            same = np.append(True, np.logical_and(*[pc.equal(inner[c].slice(1), inner[c].slice(0, len(inner) - 1)).to_numpy() for c in ("right", "left")]))
            same[low] = True
            alike = np.logical_and.reduceat(same, low)
            several = np.minimum.reduceat(doc, low) < np.maximum.reduceat(doc, low)
            whole = np.flatnonzero(alike & several)
            if len(whole):
                lows = np.repeat(doc[low[whole]], (high - low)[whole])
                rows = np.repeat(low[whole] - np.concatenate([[0], np.cumsum((high - low)[whole])[:-1]]), (high - low)[whole]) + np.arange(len(lows))
                rows = rows[doc[rows] > lows]
                picked = inner.take(pa.array(rows))
                left, right = (pc.binary_length(picked[c]).to_numpy().astype(np.int64) for c in ("left", "right"))
                anchor = picked["anchor"].to_numpy()
                yield _spans(picked["doc"].combine_chunks(), picked["hash"].combine_chunks(), anchor - left, anchor + size + right)
            for i in np.flatnonzero(~alike & several):
                bucket(inner.slice(low[i], high[i] - low[i]), None, None, out)
                if len(out.rows) >= 1 << 15:
                    yield out.batch()

        for batch in batches:
            if batch.num_rows:
                table = pa.Table.from_batches([batch])
                yield from settle(table if carry is None else pa.concat_tables([carry, table]), False)
        if carry is not None:
            yield from settle(carry, True)
        if out.rows:
            yield out.batch()

    return run


def earlier_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc, hash, start, end): byte spans of each document made of strings of ``window`` bytes that a smaller id holds as well.

    ``hash`` tells apart the texts under one id.  Spans may overlap.
    """
    texts = Texts(df, id_col, text_col)
    known = df.sparkSession.sparkContext.broadcast(repeated_grams(texts, window))
    order = ["gram", "right", "left", "doc"]
    rows = stretches(texts, window, known).repartitionByRange(*order).sortWithinPartitions(*order)
    found = write_table(rows.mapInArrow(_scan(window), _Found.SCHEMA))
    place = ["doc", "hash", "start", "end"]
    # At a cut: the smallest document of each task and string, against the smallest of all.
    strings = found.where("string is not null")
    least = strings.groupBy("gram", "string").agg(F.min("doc").alias("least"))
    cut = strings.join(least, ["gram", "string"]).where("least < doc").select(*place)
    return found.where("string is null").select(*place).unionAll(cut).unionAll(texts.copies.where(F.col("end") >= window))


def _cut_out(batches):
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, starts, ends) of texts with their spans."""
    for batch in batches:
        out = []
        for doc, text, spans in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
            raw = memoryview(text.as_buffer()) if text.is_valid else memoryview(b"")
            starts, ends = [], []
            digest, at = hashlib.sha256(), 0
            if spans.is_valid and len(spans):
                own = np.sort(spans.values.to_numpy())
                begin, end = own >> 32, own & 0xFFFFFFFF
                reach = np.maximum.accumulate(end)
                new = np.flatnonzero(np.append(True, begin[1:] > reach[:-1]))
                starts, ends = begin[new].tolist(), reach[np.append(new[1:], len(own)) - 1].tolist()
            for s, e in zip(starts, ends):
                digest.update(raw[at:s])
                at = e
            digest.update(raw[at:])
            out.append((doc, len(raw), sum(ends) - sum(starts), len(starts), digest.hexdigest(), starts, ends))
        if out:
            doc, *rest = zip(*out)
            kinds = [pa.int64()] * 3 + [pa.string()] + [pa.list_(pa.int64())] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(rest, kinds)]], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "starts", "ends"])


def drop_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """What is left of each document without the bytes of strings of ``window`` bytes that also start in one with a smaller id.

    Returns one row for each input row: ``doc_id, n_bytes, n_removed, n_spans`` (maximal removed runs), ``kept_sha256`` of the
    remaining bytes, and the runs' ``starts`` and ``ends``.  Texts are UTF-8 bytes; strings are judged on the input and never cross documents.

    Null text counts as empty.  Equal ids are not smaller than each other, so rows that repeat an id lose nothing to each other;
    null ids come after all others.  Very long texts are read in overlapping pieces.  An empty table gives an empty result; further
    columns are ignored whatever their names.
    """
    spans = earlier_spans(df, id_col, text_col, window)
    # One number for a span keeps the lists small; a text has fewer than 2^31 bytes.
    packed = F.shiftleft(F.col("start").cast("bigint"), 32) + F.col("end")
    listed = spans.groupBy("doc", "hash").agg(F.collect_set(packed).alias("spans"))
    kind = df.schema[id_col].dataType.simpleString()
    own = df.select(F.coalesce(col(id_col).cast("bigint"), F.lit(NO_ID)).alias("doc"), F.xxhash64(col(text_col).cast("string")).alias("hash"),
                    col(id_col).alias("doc_id"), col(text_col).cast("string").alias("text"))
    # Every text crosses the network once, to meet its spans.
    both = own.join(listed, ["doc", "hash"], "left").select("doc_id", "text", "spans")
    return both.mapInArrow(_cut_out, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, starts array<bigint>, ends array<bigint>")


ship_with_tasks(__name__)
