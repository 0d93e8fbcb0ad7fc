"""Repeated byte strings against every window of every document."""

import hashlib
import random

import pytest

from tablewright.llm import suffix_repeats as sr

SCHEMA = "doc_id bigint, text string"
OUT = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


def plain(rows, window):
    place, first, out = (lambda d: sr.NO_ID if d is None else d), {}, []
    for d, text in rows:
        raw = (text or "").encode()
        for p in range(len(raw) - window + 1):
            first[raw[p:p + window]] = min(first.get(raw[p:p + window], sr.NO_ID), place(d))
    for d, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - window + 1):
            if first[raw[p:p + window]] < place(d):
                gone[p:p + window] = b"\1" * window
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((d, len(raw), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def found(df, window=50):
    return sorted(map(tuple, sr.drop_repeats(df, window=window).select(*OUT).collect()), key=str)


def planted(rng):
    text = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    passages, common, rows = [text(rng.randint(30, 200)) for _ in range(6)], text(90), []
    for i in range(300):
        parts = [rng.choice([text(rng.randint(0, 80)), common, rng.choice(passages), rng.choice(passages)[rng.randint(0, 30):], "ab" * rng.randint(1, 60), "x" * rng.randint(1, 90)])
                 for _ in range(rng.randint(0, 4))]
        rows.append((rng.choice([i, i, i, i - 1, None]), "".join(parts)))
    # One passage in many surroundings: a bucket that is cut between tasks.
    rows += [(1000 + i, text(40) + common + text(40)) for i in range(250)]
    return rows + [(2000, None), (2001, ""), (2002, rows[5][1]), (-5, rows[6][1])]


@pytest.mark.parametrize("window, chunk", [(50, 4 << 20), (12, 4 << 20), (50, 300)])
def test_equals_every_window(spark, monkeypatch, window, chunk):
    monkeypatch.setattr(sr, "CHUNK", chunk)
    rows = planted(random.Random(2))
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(5), window) == plain(rows, window)


def test_full_filters_and_many_cuts_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(sr, "_passes", lambda known, hashes: hashes == hashes)
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", 41)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = planted(random.Random(3))
        assert found(spark.createDataFrame(rows, SCHEMA).repartition(3), 20) == plain(rows, 20)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])


def test_empty_repeated_rows_and_clashing_columns(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == []
    rows = [(1, "q" * 60), (1, "q" * 60), (2, "q" * 55), (None, "q" * 70), (None, "z" * 60), (None, "z" * 60), (3, "é" * 24), (4, "é" * 24), (5, "é" * 25), (6, "é" * 25)]
    df = spark.createDataFrame([r + (1, "s", [2]) for r in rows], SCHEMA + ", hash int, gram string, spans array<int>")
    assert found(df) == plain(rows, 50)


def test_groups_are_maximal_and_hold_all_occurrences():
    rng = random.Random(6)
    for _ in range(60):
        strings = [bytes(rng.choice(b"ab") for _ in range(rng.randint(3, 14))) for _ in range(rng.randint(1, 5))]
        expected = {}
        for i, s in enumerate(strings):
            for p in range(len(s)):
                for q in range(p + 3, len(s) + 1):
                    expected.setdefault(s[p:q], set()).add((i, p))
        maximal = {}
        for s, places in expected.items():
            left = {strings[i][p - 1] if p else ("start", i) for i, p in places}
            right = {strings[i][p + len(s)] if p + len(s) < len(strings[i]) else ("end", i) for i, p in places}
            if len(places) > 1 and (len(left) > 1 or any(p == 0 for _, p in places)) and (len(right) > 1 or any(p + len(s) == len(strings[i]) for i, p in places)):
                maximal[s] = places
        got = {strings[m[0][0]][m[0][1]:m[0][1] + n]: set(m) for n, m in sr.maximal_repeats(strings, 3)}
        assert got == maximal


def test_a_chunk_takes_little_memory():
    import tracemalloc

    text = random.Random(5).randbytes(sr.CHUNK)
    tracemalloc.start()
    try:
        found = sr.Anchors([text[at:at + 2000] for at in range(0, len(text), 2000)], sr.WINDOW)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(found) and peak < 150 << 20, peak >> 20
