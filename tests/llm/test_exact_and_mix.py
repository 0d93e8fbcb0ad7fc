"""Exact merge and curriculum mix against brute force, with odd inputs."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tablewright.llm import curriculum_mix, exact_merge

ODD = [(1, "Same Text", "a", "x"), (2, "same text", "b", "x"), (3, None, "a", "x"), (4, "", None, "x"), (5, "SAME TEXT", "a", None), (5, "SAME TEXT", "a", None),
       (6, "É", "b", "x"), (7, "é", "b", "x"), (None, "alone", None, "x"), (None, "same text", "a", "x"), (8, "word " * 30000, "a", "x"), (9, "\t \n", "c", "x")]
SCHEMA = "doc_id bigint, text string, source string, size string"


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


@pytest.fixture(scope="module")
def odd(spark):
    # The extra column has a name that the operators use themselves.
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.mark.parametrize("runs", [1, 16, 256])
def test_exact_groups(odd, runs):
    got = exact_merge.exact_groups(odd, runs=runs).collect()
    assert len(got) == len(ODD)
    groups = defaultdict(list)
    for doc_id, text, *_ in ODD:
        groups[hashlib.sha256(lower(text).encode()).hexdigest()].append(doc_id)
    for row in got:
        ids = groups[row.text_sha256]
        best = max((i for i in ids if i is not None), default=None)
        assert (row.keep_id, row.group_size) == (best, len(ids))
        assert not row.kept or row.doc_id == best
    assert sum(r.kept for r in got) == len(groups)
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in ODD)


def test_smallest_can_stay(odd):
    got = exact_merge.exact_groups(odd, largest=False, runs=16)
    assert {r.keep_id for r in got.collect() if r.group_size == 5} == {1}


def test_unequal_checks_stay_apart(spark):
    rows = spark.createDataFrame([(0, b"d", 1, 4, 7, 1), (1, b"d", 2, 4, 9, 1), (2, b"d", 1, 4, 8, 2)], "run bigint, digest binary, check bigint, n_bytes int, keeper bigint, n bigint")
    got = exact_merge.merge_runs(rows, 2, 2, True).collect()
    assert sorted((r.check, r.keeper, r.n) for r in got) == [(1, 8, 3), (2, 9, 1)]


def test_runs_must_be_a_power():
    with pytest.raises(ValueError):
        exact_merge.exact_groups(None, runs=12)


def test_drop_copies_keeps_columns(odd):
    got = exact_merge.drop_exact_copies(odd, runs=16)
    assert got.columns == odd.columns
    rows = got.collect()
    assert len(rows) == len({lower(r[1]) for r in ODD})
    assert Counter(r.doc_id for r in rows)[5] == 1


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert exact_merge.exact_groups(empty, runs=16).count() == 0
    assert exact_merge.drop_exact_copies(empty, runs=16).count() == 0
    assert curriculum_mix.mix(empty).count() == 0
    assert curriculum_mix.mixed_documents(empty).count() == 0


def shares(sizes, weights=(1, 2, 3), repeats=3):
    """Targets by sharing the excess again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, full, rest = dict.fromkeys(sizes, 0.0), set(), float(sum(sizes.values()))
    while rest > 1e-9 and len(full) < len(sizes):
        open_weight = sum(weight[s] for s in sizes if s not in full)
        extra = {s: rest * weight[s] / open_weight for s in sizes if s not in full}
        rest = 0.0
        for s, x in extra.items():
            target[s] += x
            if target[s] >= repeats * sizes[s] - 1e-9:
                rest += target[s] - repeats * sizes[s]
                target[s] = repeats * sizes[s]
                full.add(s)
    return target


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def check_mix(rows, got):
    sizes = Counter()
    for _, text, source, *_ in rows:
        sizes[source] += len(words(text))
    target = shares(sizes)
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source], abs=1e-6)
        assert 0 <= r.taken <= 3 * r.size
        assert (r.position is None) == (r.taken == 0)
        assert r.position is None or 0 <= r.position <= 1
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 0.5 + 1e-9
    return target


def test_mix_odd(odd):
    got = curriculum_mix.mix(odd).collect()
    assert len(got) == len(ODD)
    check_mix(ODD, got)


def test_mix_reaches_caps(spark):
    rows = [(i, "w " * (1 + i % 7), f"s{i % 5}" if i % 11 else None, "") for i in range(300)] + [(i, "w " * 400, "big", "") for i in range(300, 330)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = curriculum_mix.mix(df).collect()
    target = check_mix(rows, got)
    assert any(t == pytest.approx(3 * r.source_size) for r in got for t in [target[r.source]])
    again = curriculum_mix.mix(df.repartition(7)).collect()
    assert sorted((r.doc_id, r.taken, r.position) for r in got if r.taken) == sorted((r.doc_id, r.taken, r.position) for r in again if r.taken)


def test_positions_follow_the_schedule(spark):
    knots = ((0.0, 0.0), (0.25, 2.0), (1.0, 1.0))
    grid = [i / 50 for i in range(51)]
    df = spark.createDataFrame([(u,) for u in grid], "u double")
    got = [r[0] for r in df.select(curriculum_mix.time_of_demand(F.col("u"), F.lit(0), [knots])).collect()]

    def integral(t):
        out = 0.0
        for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
            x = min(max(t - t0, 0), t1 - t0)
            out += w0 * x + (w1 - w0) / (t1 - t0) * x * x / 2
        return out

    for u, t in zip(grid, got):
        assert integral(t) / integral(1.0) == pytest.approx(u, abs=1e-9)


def test_mixed_documents_are_whole(spark):
    rows = [(i, "\n".join(f"w{k}" for k in range(5 + i % 9)), f"s{i % 4}", str(i)) for i in range(200)] + [(7, "twin words here", "s0", "t")] * 3
    df = spark.createDataFrame(rows, SCHEMA)
    plan = curriculum_mix.mix(df).withColumn("times", F.col("full_copies") + (F.col("part_words") > 0).cast("int"))
    want = {(r.doc_id, r.source, r.size): r.times for r in plan.groupBy("doc_id", "source", "size").agg(F.sum("times").alias("times")).collect() if r.times}
    mixed = curriculum_mix.mixed_documents(df)
    assert mixed.columns == df.columns
    have, texts = Counter(), {(r[0], r[1], r[2], r[3]) for r in rows}
    for r in mixed.collect():
        assert tuple(r) in texts
        have[(r.doc_id, r.source, len(words(r.text)))] += 1
    assert dict(have) == want
    assert max(have.values()) <= 3 * 3
