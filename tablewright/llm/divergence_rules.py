"""Quality rules by distribution divergence.

Each text gives two histograms: characters by class, and words by a list of
common words of several languages (one more bin for all other words).  The mean histograms of a listed language over all its
texts that pass the length guards are its references, the means of all texts those of every other language.  A text is judged by the Jensen-Shannon distance (base 2, 0 to 1)
to the nearest language's references; texts under a minimum length are not judged by it.

One pass over the texts leaves a row of a few hundred bytes for each; references and distances come from those.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import col, process_cache, ship_with_tasks, write_table

MIN_CHARS, MIN_WORDS = 200, 100
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE = 0.25, 0.32
#: Texts that the mean of all texts counts as in a language's own mean.
PRIOR = 5.0

# Frequent function words.
COMMON_WORDS = {
    "en": "the of and to in a is that for it was on are as with be by this at from",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als",
    "fr": "de la le et les des en un du une que est pour qui dans par plus pas au sur",
    "es": "de la que el en y los se del las un por con no una su para es al lo",
}
SYMBOLS = "#*$%&|<>"
CLASSES = ("lower", "upper", "digit", "space", "stop", "symbol", "other")
_STOPS = ".,;:!?'\"()-–—«»„“”’¿¡"


def word_list(common: dict[str, str]) -> list[str]:
    return list(dict.fromkeys(w for words in common.values() for w in words.split()))


def _class_of(code: int) -> int:
    c = chr(code)
    kind = unicodedata.category(c)
    name = ("space" if c.isspace() else "stop" if c in _STOPS else "upper" if kind in ("Lu", "Lt") else "lower" if kind[0] == "L" or kind[0] == "M"
            else "digit" if kind[0] == "N" else "symbol" if kind[0] in "PS" else "other")
    return CLASSES.index(name)


def class_table() -> np.ndarray:
    """Class of every code point of the basic plane; all beyond it are 'other'."""
    table = np.full(0x10000, CLASSES.index("other"), np.int64)
    table[:0xD800] = [_class_of(c) for c in range(0xD800)]
    return table


def repeated_window_words(ids: np.ndarray, window: int = 5) -> int:
    """Words inside windows of words that occur at least twice in the text, first occurrence included.

    Windows get exact numbers, one word more at a time: number of the window so far, then of its next word.
    """
    n = len(ids) - window + 1
    if n < 2:
        return 0
    base = np.int64(int(ids.max()) + 1)
    keys, sizes = ids[:n], None
    for k in range(1, window):
        _, keys, sizes = np.unique(keys * base + ids[k:k + n], return_inverse=True, return_counts=True)
        if len(sizes) == n:
            return 0
    twice = np.flatnonzero(sizes[keys] > 1)
    change = np.zeros(len(ids) + 1, np.int64)
    change[twice] += 1
    change[twice + window] -= 1
    return int((np.cumsum(change[:-1]) > 0).sum())


def measure(text: str | None, words: dict[bytes, int], table: np.ndarray) -> tuple:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words``, class counts and common-word counts of a whole text."""
    text = text or ""
    tokens = text.encode("utf-8", "replace").split()
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    classes = np.bincount(table[np.minimum(codes, 0xFFFF)], minlength=len(CLASSES))
    blanks = sum(map(text.count, " \t\n\v\f\r"))
    lines = [line for line in text.split("\n") if line.strip(" \t\n\v\f\r")]
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(t, len(known)) for t in tokens), np.int64, len(tokens))
    common = np.zeros(len(words) + 1, np.int64)
    if tokens:
        uses = np.bincount(ids, minlength=len(known))
        for token, i in known.items():
            common[words.get(token.lower().strip(b".,;:!?"), -1)] += uses[i]
    return (len(tokens), len(text) - blanks, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_window_words(ids), classes, common)


def measures(df: DataFrame, id_col: str, text_col: str, lang_col: str, common: dict[str, str]) -> DataFrame:
    listed = word_list(common)

    def run(batches):
        table = process_cache("character classes", class_table)
        words = {w.encode(): i for i, w in enumerate(listed)}
        for batch in batches:
            rows = [measure(t.as_py(), words, table) for t in batch.column(2)]
            numbers = [pa.array([r[k] for r in rows], pa.int64()) for k in range(5)]
            histograms = [pa.array([r[k].tolist() for r in rows], pa.list_(pa.int64())) for k in (5, 6)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *numbers, *histograms],
                                             ["doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "classes", "common"])

    rows = df.select(col(id_col).alias("doc_id"), col(lang_col).cast("string").alias("lang"), col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {df.schema[id_col].dataType.simpleString()}, lang string, n_words bigint, word_chars bigint, n_symbols bigint, "
                                "n_dup_lines bigint, n_repeat_words bigint, classes array<bigint>, common array<bigint>")


def references(rows: DataFrame, languages, size: int, column: str, total, guard) -> list[list[float]]:
    """Mean histograms over the rows that pass the guard: of each listed language, and of all texts for every other one.

    A language's mean counts the mean of all texts as ``PRIOR`` texts of its own, so that a few texts shade into many
    without a limit between them.
    """
    shares = [F.sum(F.col(column)[k] / total).alias(f"s{k}") for k in range(size)]
    named = F.when(F.col("lang").isin(*languages), F.col("lang")).alias("lang") if languages else F.lit(None).cast("string").alias("lang")
    # At most one short row for each listed language and one for the others.
    found = rows.where(guard).groupBy(named).agg(F.count(F.lit(1)).alias("n"), *shares).collect()
    if not found:
        return []
    sums = {r["lang"]: (r["n"], np.array([r[f"s{k}"] for k in range(size)])) for r in found}
    pooled = sum(s for _, s in sums.values()) / sum(n for n, _ in sums.values())
    return [pooled.tolist()] + [((s + PRIOR * pooled) / (n + PRIOR)).tolist() for lang, (n, s) in sorted(sums.items(), key=lambda x: str(x[0])) if lang is not None]


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of ``p`` to ``q``, base 2."""
    mean = (p + q) / 2
    part = lambda x: np.where(x > 0, x * np.log2(np.where(x > 0, x, 1) / np.where(mean > 0, mean, 1)), 0).sum(-1)
    return np.sqrt(np.maximum(0, (part(p) + part(q)) / 2))


def _nearest(counts: np.ndarray, refs: list) -> np.ndarray:
    share = counts / np.maximum(1, counts.sum(1, keepdims=True))
    return np.min([js_distance(share, np.asarray(q)) for q in refs], axis=0) if refs else np.zeros(len(counts))


def rule_verdicts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                  common: dict[str, str] = COMMON_WORDS, min_chars: int = MIN_CHARS, min_words: int = MIN_WORDS,
                  max_class_distance: float = MAX_CLASS_DISTANCE, max_word_distance: float = MAX_WORD_DISTANCE) -> DataFrame:
    """One row for each text: ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    class_distance, word_distance, kept``.

    ``base_failed``: under 10 words, or more than a fifth of the words in repeated 5-word windows.  Others are kept unless
    a distance exceeds its limit; under ``min_chars`` characters or ``min_words`` words that distance is null and rejects nothing.

    Null text counts as empty: no words, base failed.  A null or unlisted language is judged by the mean of all texts and
    the listed languages.
    Repeated rows each get a row and count each.  Without references nothing is rejected by distance.  An empty table
    gives an empty result; further columns are ignored.
    """
    rows = write_table(measures(df, id_col, text_col, lang_col, common))
    width = len(word_list(common)) + 1
    n_chars = F.aggregate("classes", F.lit(0).cast("bigint"), lambda a, x: a + x)
    by_class = references(rows, list(common), len(CLASSES), "classes", n_chars, n_chars >= min_chars)
    by_word = references(rows, list(common), width, "common", F.col("n_words"), F.col("n_words") >= min_words)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            grid = [np.array(batch.column(k).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(batch.num_rows, -1) for k in (7, 8)]
            words = batch.column(2).to_numpy()
            distances = [np.where(grid[0].sum(1) >= min_chars, _nearest(grid[0], by_class), np.nan), np.where(words >= min_words, _nearest(grid[1], by_word), np.nan)]
            failed = (words < 10) | (100 * batch.column(6).to_numpy() > 20 * words)
            far = (distances[0] > max_class_distance) | (distances[1] > max_word_distance)
            out = [batch.column(0), *[batch.column(k) for k in range(2, 7)], pa.array(failed), *[pa.array(d, from_pandas=True) for d in distances], pa.array(~failed & ~far)]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                                   "base_failed", "class_distance", "word_distance", "kept"])

    return rows.mapInArrow(run, f"doc_id {df.schema[id_col].dataType.simpleString()}, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
                                "n_repeat_words bigint, base_failed boolean, class_distance double, word_distance double, kept boolean")


ship_with_tasks(__name__)
