"""Collocations against a plain count of every phrase."""

import random
import re
from collections import Counter, defaultdict

import pytest

from tablewright.llm import phrase_streams as ps

SCHEMA = "doc_id bigint, text string, lang string"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least=10, words=3, top=2000):
    counts, total = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(w)
            for n in range(1, words + 1):
                for i in range(len(w) - n + 1):
                    counts[lang or "und"][tuple(w[i:i + n])] += 1
    out = []
    for lang, f in counts.items():
        found, longer = [], [p for p, a in f.items() if a >= least and len(p) > 1]
        for p in longer:
            a = f[p]
            score, k = min((SCALE * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            if not any(100 * f[q] >= 50 * a for q in longer if len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q)))):
                found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, total[lang], -score) for i, (score, a, p, left, right) in enumerate(sorted(found)[:top])]
    return sorted(out)


SCALE = 1_000_000


def found(df, **options):
    rows = ps.collocations(df, **options)
    assert rows.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(map(tuple, rows.collect()))


def planted(rng):
    vocabulary = ["a", "Bé", "cat", "the", "of", "ß", "ÀB", "x\x01", "y\x0e", "日本", "new", "york"]
    rows = []
    for i in range(300):
        text = ""
        for _ in range(rng.randint(0, 40)):
            text += rng.choices(vocabulary, range(1, 13))[0] + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "!?", " ; "])
        rows.append((i, text, rng.choice(["en", "de", None])))
    rows += [(900 + i, "new york city hall", "en") for i in range(25)] + [(None, None, "fr"), (3, "", None), (4, " .,\n", "de"), (5, "Word", "xx")]
    return rows


@pytest.mark.parametrize("least, words, chunk", [(10, 3, 1 << 20), (3, 4, 2000), (5, 2, 1)])
def test_equals_plain_counts(spark, monkeypatch, least, words, chunk):
    monkeypatch.setattr(ps, "CHUNK", chunk)
    rows = planted(random.Random(8))
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert found(df, least=least, words=words) == plain(rows, least, words)
    assert found(df, least=least, words=words, top=7) == plain(rows, least, words, 7)


def test_a_full_filter_changes_no_count(spark, monkeypatch):
    monkeypatch.setattr(ps, "FILTER_BITS", 3)
    rows = planted(random.Random(9))
    assert found(spark.createDataFrame(rows, SCHEMA)) == plain(rows)


def test_empty_long_repeated_and_clashing_columns(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == []
    rows = [(1, "one two three. " * 20_000 + "z" * 100_000, "en"), (1, "one two three. " * 20_000 + "z" * 100_000, "en"), (2, None, None)]
    df = spark.createDataFrame([r + (1, "p", 2) for r in rows], SCHEMA + ", n int, phrase string, words int")
    assert found(df) == plain(rows)


def test_scores_beyond_64_bits(spark):
    big = 5_000_000_000
    row = spark.createDataFrame([(big, big + 1, big)], "a bigint, l1 bigint, r1 bigint").select(ps._cut(1).alias("score")).first()
    assert row.score == 1_000_000 * big * big // ((big + 1) * big)
