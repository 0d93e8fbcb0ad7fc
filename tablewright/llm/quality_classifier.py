"""Quality classifier: random-indexing word vectors, pooled, and a small network.

Random indexing gives every word bucket a sparse random index vector of -1 and 1.  A word's context vector
is the sum of the index vectors of the words near it in the fitting texts; its word vector joins both.  Words are seen
twice: as letters, and as a shape ("A!", "a*", "0"), each with vectors of its own.  Marks for words that repeat the word
before or an earlier one count as words.  A text is the mean of its words' vectors.

A two-layer numpy network turns the mean into a logit; a temperature found on rows kept
from the fit calibrates its probability.  The model's size is fixed, so it is shipped to the tasks;
scoring is a map over whole texts without a shuffle.  Words and weights come from at most
``max_rows`` labelled texts, chosen by hash over all of them.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import asdict, dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import col, process_cache, ship_with_tasks, write_table

DIM, BUCKETS, SHAPES, NONZERO, WINDOW = 32, 1 << 14, 512, 4, 2
HIDDEN, EPOCHS, SEED = 24, 60, 7
#: Labelled texts that the fit uses at most; the smallest by hash of id.
MAX_FIT_ROWS = 4000
THRESHOLD = 0.7
CACHE_WORDS = 300_000
SAME, AGAIN = 0, 1


def held_out(id_column: Column, remainder: int = 2) -> Column:
    """crc32 of the id as text leaves this remainder modulo 4."""
    return F.coalesce(F.pmod(F.crc32(id_column.cast("string").cast("binary")), F.lit(4)) == remainder, F.lit(False))


def index_vectors() -> np.ndarray:
    """Index vector of each shape (first SHAPES rows) and each word bucket."""
    rng = np.random.default_rng(SEED)
    out = np.zeros((SHAPES + BUCKETS, DIM), np.float32)
    for k in range(NONZERO):
        out[np.arange(len(out)), rng.integers(0, DIM, len(out))] += rng.choice([-1.0, 1.0], len(out))
    return out / np.sqrt(NONZERO)


_PUNCTUATION = ".,;:!?*$&#%|\"'()<>-"


def _letters_shape(run: str) -> str:
    return "a" if run.islower() else "A" if run.isupper() and len(run) > 1 else "Aa" if run[0].isupper() else "a"


def shape_of(word: str) -> str:
    """Letters as A, Aa or a, digits as 0; other signs stay, runs of one sign once."""
    core = word.rstrip(_PUNCTUATION)
    if core.isalpha():
        return _letters_shape(core) + re.sub(r"(.)\1+", r"\1", word[len(core):])
    signs = re.sub(r"\d+", "0", re.sub(r"[^\W\d_]+", lambda m: _letters_shape(m.group()), word))
    return re.sub(r"([^\w])\1+", r"\1", signs)[:24]


class WordRows(dict):
    """Rows of a word in the vector table, of its letters and of its shape, as one number."""

    def __missing__(self, word: str) -> int:
        shape = 2 + zlib.crc32(shape_of(word).encode("utf-8", "replace")) % (SHAPES - 2)
        letters = zlib.crc32(word.strip(_PUNCTUATION).lower().encode("utf-8", "replace")) % BUCKETS
        self[word] = row = letters * SHAPES + shape
        return row

    def of(self, words, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self) > CACHE_WORDS:
            self.clear()
        both = np.fromiter(map(self.__getitem__, words), np.int64, n)
        return SHAPES + both // SHAPES, both % SHAPES


def _rows() -> WordRows:
    return process_cache("quality word rows", WordRows)


def _add_rows(sums: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """sums[at] += rows, for places that repeat."""
    order = np.argsort(at, kind="stable")
    places, first = np.unique(at[order], return_index=True)
    sums[places] += np.add.reduceat(rows[order], first, axis=0)


def context_sums(texts, index: np.ndarray, words_at_once: int = 20_000) -> np.ndarray:
    """Sums of the neighbours' index vectors for each row of the table."""
    sums, rows = np.zeros_like(index), _rows()
    for text in texts:
        words = (text or "").split()
        for at in range(0, len(words), words_at_once):
            # Parts overlap by the window; a word looks ahead only, and each pair counts for both.
            part = words[at:at + words_at_once + WINDOW]
            for ids in rows.of(part, len(part)):
                for gap in range(1, WINDOW + 1):
                    here, there = ids[:-gap][:words_at_once], ids[gap:][:words_at_once]
                    if len(here):
                        _add_rows(sums, np.concatenate([here, there]), index[np.concatenate([there, here])])
    return sums


def word_vectors(sums: np.ndarray, index: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(sums, axis=1, keepdims=True)
    return np.concatenate([index, sums / np.maximum(length, 1e-9)], axis=1).astype(np.float32)


def pooled(text: str | None, vectors: np.ndarray) -> np.ndarray:
    """Mean word vector of a whole text, and the logarithm of its number of words."""
    words = (text or "").split()
    out = np.zeros(vectors.shape[1] * 2 + 1, np.float32)
    if not words:
        return out
    counts = Counter(words)
    letters, shapes = _rows().of(counts, len(counts))
    n, weight = len(words), np.fromiter(counts.values(), np.float32, len(counts)) / len(words)
    half = vectors.shape[1]
    out[:half] = weight @ vectors[letters]
    out[half:-1] = np.bincount(shapes, weight, SHAPES).astype(np.float32) @ vectors[:SHAPES]
    out[half:-1] += vectors[SAME] * (sum(map(eq, words, words[1:])) / n) + vectors[AGAIN] * (1 - len(counts) / n)
    out[-1] = np.log1p(n)
    return out


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def fit_network(x: np.ndarray, y: np.ndarray, hidden: int = HIDDEN, epochs: int = EPOCHS, seed: int = SEED) -> Network:
    """Adam on the log loss with weight decay; every fifth row is kept back for the temperature."""
    rng = np.random.default_rng(seed)
    back = np.arange(len(y)) % 5 == 4
    mean, scale = x.mean(0), x.std(0) + 1e-3
    net = Network(mean, scale, rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), 0.0)
    if len(y) < 10 or len(set(y.tolist())) < 2:
        # Nothing to tell apart: the smoothed share of the label.
        share = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.5
        net.w2[:], net.b2 = 0, float(np.log(share / (1 - share)))
        return net
    z, t = (x[~back] - mean) / scale, y[~back]
    params = [net.w1, net.b1, net.w2, np.zeros(1)]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(len(t)), max(1, len(t) // 128)):
            h = np.tanh(z[part] @ params[0] + params[1])
            error = (1 / (1 + np.exp(-np.clip(h @ params[2] + params[3], -40, 40))) - t[part]) / len(part)
            back_h = np.outer(error, params[2]) * (1 - h * h)
            grads = [z[part].T @ back_h + 1e-3 * params[0], back_h.sum(0), h.T @ error + 1e-3 * params[2], error.sum(keepdims=True)]
            step += 1
            for p, g, m, v in zip(params, grads, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= 0.01 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = params[0], params[1], params[2], float(params[3][0])
    logits, truth = net.logits(x[back]), y[back]
    loss = lambda temp: np.mean(np.logaddexp(0, -np.where(truth == 1, 1, -1) * logits / temp))
    net.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))
    return net


def fit_sample(docs: DataFrame, labels: DataFrame, max_rows: int, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(text, y) of at most ``max_rows`` labelled texts outside the held-out part, the smallest by hash of id."""
    usable = (labels.select(col(id_col).alias("_id"), col(label_col).alias("y")).where(F.col("_id").isNotNull() & F.col("y").isNotNull() & ~held_out(F.col("_id")))
              .groupBy("_id").agg(F.max("y").alias("y")))
    chosen = usable.orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    texts = docs.select(col(id_col).alias("_id"), col(text_col).cast("string").alias("text"))
    # At most max_rows ids and labels.
    return texts.join(F.broadcast(chosen), "_id").select(F.xxhash64("_id").alias("order"), "text", (F.col("y") > 0).cast("double").alias("y"))


@dataclass
class QualityModel:
    vectors: np.ndarray
    network: Network


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
                max_rows: int = MAX_FIT_ROWS, parts: int = 6) -> QualityModel:
    """Fit vectors and network on the sample; only sums and pooled vectors, both of fixed size, reach the driver."""
    sample = write_table(fit_sample(docs, labels, max_rows, id_col, text_col, label_col).repartition(parts, "order").sortWithinPartitions("order", "text"))

    def sums(batches):
        index = index_vectors()
        total = np.zeros_like(index)
        for batch in batches:
            total += context_sums(batch.column(0).to_pylist(), index)
        used = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array([used.astype("<i4").tobytes()]), pa.array([total[used].astype("<f4").tobytes()])], ["used", "total"])

    index = index_vectors()
    total = np.zeros_like(index)
    for row in sample.select("text").mapInArrow(sums, "used binary, total binary").collect():
        total[np.frombuffer(row["used"], "<i4")] += np.frombuffer(row["total"], "<f4").reshape(-1, DIM)
    vectors = word_vectors(total, index)
    shipped = docs.sparkSession.sparkContext.broadcast(vectors)

    def pool(batches):
        for batch in batches:
            found = [pooled(t.as_py(), shipped.value).astype("<f4").tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.binary())], ["order", "y", "x"])

    rows = sorted(sample.mapInArrow(pool, "order bigint, y double, x binary").collect(), key=lambda r: (r["order"], r["x"]))
    x = np.array([np.frombuffer(r["x"], "<f4") for r in rows], np.float64).reshape(len(rows), vectors.shape[1] * 2 + 1)
    if not len(x):
        return QualityModel(vectors, Network(np.zeros(x.shape[1]), np.ones(x.shape[1]), np.zeros((x.shape[1], HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), 0.0))
    return QualityModel(vectors, fit_network(x, np.array([r["y"] for r in rows])))


def score_quality(df: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD,
                  keep_columns: bool = False) -> DataFrame:
    """``doc_id, score`` for each row: the calibrated probability of label 1.  Texts without words get a score too.

    With ``keep_columns`` the rows whose score reaches ``threshold`` come back whole instead, columns unchanged.
    Null counts as empty.
    """
    # Plain arrays of fixed size, so that workers need no class of ours to read them.
    shipped = df.sparkSession.sparkContext.broadcast((model.vectors, asdict(model.network)))

    def scores(column):
        vectors, parameters = shipped.value
        x = np.array([pooled(t.as_py(), vectors) for t in column], np.float64).reshape(len(column), vectors.shape[1] * 2 + 1)
        return Network(**parameters).probabilities(x)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores(batch.column(1)))], ["doc_id", "score"])

    if not keep_columns:
        rows = df.select(col(id_col).alias("doc_id"), col(text_col).cast("string").alias("text"))
        return rows.mapInArrow(run, f"doc_id {df.schema[id_col].dataType.simpleString()}, score double")

    at = df.columns.index(text_col)

    def keep(batches):
        for batch in batches:
            yield batch.filter(pa.array(scores(batch.column(at)) >= threshold))

    return df.mapInArrow(keep, df.schema)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
             threshold: float = THRESHOLD, max_rows: int = MAX_FIT_ROWS) -> DataFrame:
    """One row for each document: ``doc_id, held_out, score, predicted``.

    Labels, language, source and id are no inputs of the score.  An id with several labels counts as its largest.  Null
    labels and ids are left out of the fit; null text counts as empty; documents with null or repeated ids are scored row by row, null ids
    aren't held out.  With no usable label every score is 0.5; with one kind of label it's that label's smoothed share.
    Empty tables give an empty result; further columns are ignored.
    """
    model = fit_quality(docs, labels, id_col, text_col, label_col, max_rows)
    return (score_quality(docs, model, id_col, text_col)
            .select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
              threshold: float = THRESHOLD, max_rows: int = MAX_FIT_ROWS) -> DataFrame:
    """The documents whose score reaches the threshold, with their own columns."""
    return score_quality(docs, fit_quality(docs, labels, id_col, text_col, label_col, max_rows), id_col, text_col, threshold, keep_columns=True)


ship_with_tasks(__name__)
