"""Packing documents into token sequences by linear grouping.

Tokenising and placing are Spark jobs; between them only a histogram of piece lengths, at most
``capacity`` numbers, reaches the driver, and a plan bounded by it goes back.

The plan works on counts.  Lengths above a share of the capacity are large: in order of length they form
groups of equal cardinality, and each is rounded up to the longest of its group.  Few sizes are left, so a linear
programme over configurations (multisets of sizes that fit a sequence) is solved by column generation with a knapsack.
Its rounded-down solution opens sequences; the documents' real lengths take the rounded slots, in order of length.
Large ones left over by the rounding, then all small ones, go best-fit: each into the fullest sequence that still holds it.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections import Counter, defaultdict
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from .common import col, process_cache, ship_with_tasks, write_table

CAPACITY = 4096
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
#: Shares of the capacity up to which a piece may count as small, and number of groups of large ones.  The plan with the
#: fewest sequences is taken.
SMALL = (1 / 4, 1 / 3, 0.45)
GROUPS = 64
#: Buckets over which the pieces of one length are ranked.
RANK_BUCKETS = 256
#: Chunks of text after which a Python process begins a new generation of its cache.
CACHE_CHUNKS = 500_000
_TAIL = b".,!?*$&#%;:|"


class ChunkEncoder:
    """Ids of a text from the ids of its chunks between ASCII white space.

    The tokenizer drops white space and never joins across it, so a text's ids are its chunks' ids in a row.  It also
    lower-cases, and splits letters from punctuation, so a chunk after a letter or digit may be looked up without
    its closing punctuation.  Chunks that could hold a special token are left as they are.
    """

    def __init__(self, path: str, limit: int = CACHE_CHUNKS):
        # Spark has a task on every core already.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        # Two generations: a full cache grows old, and what is still in use moves on.
        self.limit, self.known, self.old = limit, {}, {}

    def _encode(self, chunk: bytes) -> bytes:
        """Ids of one chunk, by the tokenizer's own parts; its pipeline as a whole is slower for single chunks."""
        text = chunk.decode("utf-8", "replace")
        if "<|" in text:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        elif text.isascii() and text.isalpha() and text.islower():
            # Nothing to normalise or split, and byte-level spelling is the text itself.
            ids = [t.id for t in self.tokenize(text)]
        else:
            pieces = self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(text))
            ids = [t.id for piece, _ in pieces for t in self.tokenize(piece)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _recall(self, chunk: bytes) -> bytes | None:
        ids = self.known.get(chunk)
        if ids is None:
            ids = self.old.get(chunk)
            if ids is not None:
                self.known[chunk] = ids
        return ids

    def learn(self, chunks: set[bytes]) -> None:
        """Have the ids of all the chunks in the cache's young generation."""
        if len(self.known) > self.limit:
            self.known, self.old = {}, self.known
        known, recall = self.known, self._recall
        whole, split = [], []
        for c in chunks:
            if c in known or recall(c) is not None:
                continue
            core = c.rstrip(_TAIL)
            last = core[-1:]
            if len(core) < len(c) and last and b"<|" not in c and (last.isalnum() or last > b"\x7f" and core.decode("utf-8", "replace")[-1].isalpha()):
                split.append((c, core, c[len(core):]))
            else:
                whole.append(c)
        need = {part for _, core, tail in split for part in (core, tail) if part not in known and recall(part) is None}
        need.update(whole)
        for c in need:
            known[c] = self._encode(c)
        for c, core, tail in split:
            known[c] = known[core] + known[tail]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        rows, seen = [], set()
        for text in texts:
            data = (text or "").encode("utf-8", "replace")
            rows.append((data if b"<|" in data else data.lower()).split())
            seen.update(rows[-1])
        self.learn(seen)
        get = self.known.__getitem__
        return [b"".join(map(get, row)) for row in rows]


def encoder(path: str) -> ChunkEncoder:
    return process_cache(f"encoder:{path}", lambda: ChunkEncoder(path))


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
           tokenizer: str | None = None, texts_at_once: int = 256) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` for each piece of at most ``capacity`` ids.

    A document is the ids of its whole text and the end id.  ``tokenizer`` is a path that every machine has; by
    default the public vocabulary is looked up where the task runs.
    """
    def run(batches):
        enc = encoder(tokenizer or tokenizer_path())
        end = np.asarray([END_ID], "<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, texts_at_once):
                part = batch.slice(at, texts_at_once)
                rows, no, start, length, crc = [], [], [], [], []
                for i, ids in enumerate(enc.encode(part.column(1).to_pylist())):
                    ids += end
                    for k, lo in enumerate(range(0, len(ids), 4 * capacity)):
                        cut = ids[lo:lo + 4 * capacity]
                        rows.append(i), no.append(k), start.append(lo // 4), length.append(len(cut) // 4), crc.append(zlib.crc32(cut))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(rows, pa.int64())), pa.array(no, pa.int32()), *[pa.array(x, pa.int64()) for x in (start, length, crc)]],
                    ["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = df.select(col(id_col).alias("doc_id"), col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {df.schema[id_col].dataType.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint")


# ---------------------------------------------------------------- the plan

class Sequences:
    """Sequences being filled, as runs of sequences that hold the same lengths.

    ``slots`` collects (length, first rank, end rank, sequence, offset, each): rank r of that length goes to sequence
    ``sequence + (r - first) // each``, at ``offset + (r - first) % each * length``.
    """

    def __init__(self, capacity: int):
        self.capacity, self.opened, self.slots = capacity, 0, []
        self.runs: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.has = np.zeros(capacity + 1, bool)

    def open(self, count: int) -> tuple[int, int]:
        self.opened += count
        return self.opened - count, count

    def leave(self, space: int, first: int, many: int) -> None:
        if many and space:
            self.runs[space].append((first, many))
            self.has[space] = True

    def put(self, length: int, rank: int, count: int, sequence: int, offset: int, each: int = 1) -> None:
        self.slots.append((length, rank, rank + count, sequence, offset, each))

    def best_fit(self, length: int, rank: int, count: int) -> None:
        """Place ``count`` pieces of one length, from ``rank`` on, each in the fullest sequence with room.

        After a piece its sequence is still the fullest with room, so it takes as many as go in before the next one.
        """
        while count:
            if self.has[length:].any():
                space = length + int(self.has[length:].argmax())
                first, many = self.runs[space].pop()
                self.has[space] = bool(self.runs[space])
                each = space // length
            else:
                space, each = self.capacity, self.capacity // length
                first, many = self.open(-(-count // each))
            filled = min(many, count // each)
            for sequences, held in ((filled, each), (int(filled < many and count > filled * each), count - filled * each)):
                if sequences:
                    self.put(length, rank, sequences * held, first, self.capacity - space, held)
                    self.leave(space - held * length, first, sequences)
                    rank, count, first, many = rank + sequences * held, count - sequences * held, first + sequences, many - sequences
            self.leave(space, first, many)


def best_configuration(sizes: list[int], values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The multiset of sizes that fits and is worth most, by rounds of one more piece each."""
    best, choices = np.zeros(capacity + 1), []
    for _ in range(capacity // min(sizes)):
        now, choice = best.copy(), np.full(capacity + 1, -1)
        for i, size in enumerate(sizes):
            worth = best[:capacity + 1 - size] + values[i]
            better = worth > now[size:] + 1e-12
            now[size:][better], choice[size:][better] = worth[better], i
        if (choice < 0).all():
            break
        best = now
        choices.append(choice)
    pattern, room = np.zeros(len(sizes), np.int64), capacity
    for choice in reversed(choices):
        if choice[room] >= 0:
            pattern[choice[room]] += 1
            room -= sizes[choice[room]]
    return float(best[capacity]), pattern


def optimal_configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[np.ndarray, int]]:
    """(configuration, sequences) of the linear programme's solution, rounded down.

    Revised simplex on the configurations in use; a knapsack with the dual values finds the next one to bring in.  A step
    limit only ends the search for better ones: every basis on the way is a feasible solution.
    """
    n = len(sizes)
    basis = np.diag([capacity // s for s in sizes]).astype(float)
    need = np.asarray(demand, float)
    for _ in range(40 * n):
        value, pattern = best_configuration(sizes, np.linalg.solve(basis.T, np.ones(n)), capacity)
        if value <= 1 + 1e-9:
            break
        amounts, step = np.linalg.solve(basis, need), np.linalg.solve(basis, pattern.astype(float))
        ratio = np.where(step > 1e-9, np.maximum(amounts, 0) / np.where(step > 1e-9, step, 1), np.inf)
        basis[:, int(ratio.argmin())] = pattern
    amounts, left, out = np.linalg.solve(basis, need), list(demand), []
    for k in np.argsort(-amounts):
        pattern = basis[:, k].round().astype(np.int64)
        used = np.flatnonzero(pattern)
        count = min([int(np.floor(amounts[k] + 1e-6)), *[left[i] // int(pattern[i]) for i in used]])
        if count > 0:
            for i in used:
                left[i] -= count * int(pattern[i])
            out.append((pattern, count))
    return out


def pack_plan(histogram: dict[int, int], capacity: int = CAPACITY, small: Sequence[float] = SMALL, groups: int = GROUPS) -> tuple[list[tuple], int]:
    """Slots for all pieces of a histogram {length: pieces}, and the number of sequences; see :data:`SMALL`."""
    return min((grouped_plan(histogram, capacity, share, groups) for share in small), key=lambda plan: plan[1])


def grouped_plan(histogram: dict[int, int], capacity: int, small: float, groups: int) -> tuple[list[tuple], int]:
    """The linear grouping plan for one meaning of small."""
    out = Sequences(capacity)
    if histogram.get(capacity):
        out.put(capacity, 0, histogram[capacity], out.open(histogram[capacity])[0], 0)
    large = [(length, histogram[length]) for length in sorted(histogram, reverse=True) if capacity * small < length < capacity]
    total = sum(n for _, n in large)
    per_group = max(1, -(-total // groups))
    # Groups of equal cardinality: [length, first rank, pieces] each, longest first.
    members: list[list[list[int]]] = []
    room = 0
    for length, n in large:
        rank = 0
        while n:
            if not room:
                members.append([])
                room = per_group
            take = min(n, room)
            members[-1].append([length, rank, take])
            rank, n, room = rank + take, n - take, room - take
    if members:
        sizes = [m[0][0] for m in members]
        for pattern, count in _merged(optimal_configurations(*_distinct(sizes, members), capacity), members, sizes):
            _substitute(out, members, pattern, count)
    for part in [m for g in members for m in g if m[2]]:
        out.best_fit(*part)
    for length in sorted((x for x in histogram if x <= capacity * small and x < capacity), reverse=True):
        out.best_fit(length, 0, histogram[length])
    return out.slots, out.opened


def _distinct(sizes: list[int], members: list) -> tuple[list[int], list[int]]:
    """Rounded sizes and their demand; groups that round to the same size count together."""
    need = Counter()
    for size, group in zip(sizes, members):
        need[size] += sum(m[2] for m in group)
    return list(need), list(need.values())


def _merged(configurations: list, members: list, sizes: list[int]) -> list[tuple[list[list], int]]:
    """Configurations as lists of member lists: for each piece of a configuration the parts it draws from."""
    by_size: dict[int, list] = {}
    for size, group in zip(sizes, members):
        by_size.setdefault(size, []).append(group)
    order = list(by_size)
    return [([by_size[order[i]] for i in np.flatnonzero(p) for _ in range(int(p[i]))], n) for p, n in configurations]


def _draw(parts: list[list[list[int]]], count: int) -> list[tuple[int, int, int]]:
    """The next ``count`` pieces, longest first, as (length, rank, pieces)."""
    drawn = []
    for group in parts:
        for m in group:
            take = min(m[2], count)
            if take:
                drawn.append((m[0], m[1], take))
                m[1], m[2], count = m[1] + take, m[2] - take, count - take
    return drawn


def _substitute(out: Sequences, members: list, slots: list[list], count: int) -> None:
    """Open ``count`` sequences of a configuration and fill its slots with real pieces."""
    first, _ = out.open(count)
    layers = [_draw(parts, count) for parts in slots]
    cuts = sorted({0, count} | {int(x) for layer in layers for x in np.cumsum([n for _, _, n in layer])})
    at = [0] * len(layers)
    used = [0] * len(layers)
    for lo, hi in zip(cuts, cuts[1:]):
        offset = 0
        for k, layer in enumerate(layers):
            length, rank, n = layer[at[k]]
            out.put(length, rank + used[k], hi - lo, first + lo, offset)
            offset += length
            used[k] += hi - lo
            if used[k] == n:
                at[k], used[k] = at[k] + 1, 0
        out.leave(out.capacity - offset, first + lo, hi - lo)


# ---------------------------------------------------------------- the job

def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, small: Sequence[float] = SMALL,
         groups: int = GROUPS, tokenizer: str | None = None) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` for each piece of each document.

    Only documents longer than ``capacity`` ids are cut; pieces lie in their sequence without gaps from offset 0.

    Null and empty texts are one piece, the end id.  Null and repeated ids are packed row by row.  Pieces of equal length
    are interchangeable; ties fall by id.  An empty table gives an empty result; further columns are ignored.
    """
    spark = df.sparkSession
    cut = write_table(pieces(df, id_col, text_col, capacity, tokenizer)
                      .withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(RANK_BUCKETS))))
    counts = cut.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots, _ = pack_plan(histogram, capacity, small, groups)
    # A slot row for each length and run of like sequences: bounded by the capacity, not by the table.
    plan = F.broadcast(spark.createDataFrame(slots, "slot_length bigint, first_rank bigint, end_rank bigint, sequence bigint, place bigint, each bigint"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")
    offsets = counts.select("length", "bucket", before.alias("rank_start"))
    nth = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = cut.join(offsets, ["length", "bucket"]).withColumn("rank", F.col("rank_start") + nth)
    here = F.col("rank") - F.col("first_rank")
    return (ranked.join(plan, (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("end_rank")))
            .select("doc_id", "piece", "start", "length", "ids_crc32",
                    (F.col("sequence") + F.floor(here / F.col("each"))).alias("sequence_id"),
                    (F.col("place") + (here % F.col("each")) * F.col("length")).alias("offset")))


ship_with_tasks(__name__)
