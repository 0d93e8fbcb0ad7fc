"""Packing: plans hold every piece once, tokens equal the tokenizer's, jobs place without gaps."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tablewright.llm import group_packing as g

tokenizers = pytest.importorskip("tokenizers")
ODD = ["", None, "plain words here", "MiXeD CaSe, don't! 3.14 £5 Été é x", "<|endoftext|> a <|ENDOFTEXT|>", "a b c\x1cd", "word " * 9000, "###***", "İstanbul ΣΣ", "'s 'll it's,", "日本語。text"]


def placed(histogram, capacity, plan):
    slots, n = plan
    seen, sequences = Counter(), defaultdict(list)
    for length, lo, hi, sequence, offset, each in slots:
        for r in range(lo, hi):
            seen[length, r] += 1
            sequences[sequence + (r - lo) // each].append((offset + (r - lo) % each * length, length))
    assert set(seen.values()) <= {1}
    assert Counter(length for length, _ in seen) == Counter(histogram)
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(sequences) == n
    return n


@pytest.mark.parametrize("seed", range(40))
def test_plans_are_packings(seed):
    rng = random.Random(seed)
    capacity = rng.choice([8, 64, 100, 512])
    histogram = {rng.randint(1, capacity): rng.randint(1, 60) for _ in range(rng.randint(1, 40))}
    n = placed(histogram, capacity, g.pack_plan(histogram, capacity, groups=rng.choice([1, 4, 32])))
    assert n >= sum(k * v for k, v in histogram.items()) / capacity


def test_known_optimum():
    # Thirds and halves that only pair up among themselves.
    assert g.pack_plan({34: 30, 33: 60, 50: 20}, 100)[1] == 40


def test_plan_is_near_the_bound_and_bounded():
    rng = random.Random(1)
    histogram = Counter(min(4096, int(rng.lognormvariate(6.5, 1.2)) + 1) for _ in range(200_000))
    slots, n = g.pack_plan(histogram)
    bound = sum(k * v for k, v in histogram.items()) / 4096
    assert n <= 1.01 * bound + 1
    ten_times, _ = g.pack_plan({k: 10 * v for k, v in histogram.items()})
    assert len(ten_times) < 3 * len(slots)


def test_configuration_is_the_best():
    rng = np.random.default_rng(0)
    for _ in range(30):
        sizes = sorted(set(rng.integers(5, 40, 5).tolist()))
        values = rng.random(len(sizes))
        best = np.zeros(61)
        for c in range(61):
            best[c] = max([0.0] + [best[c - s] + v for s, v in zip(sizes, values) if s <= c])
        value, pattern = g.best_configuration(sizes, values, 60)
        assert value == pytest.approx(best[60]) and value == pytest.approx(float(pattern @ values)) and pattern @ np.array(sizes) <= 60


def test_chunk_encoder_equals_the_tokenizer():
    path = g.tokenizer_path()
    plain = tokenizers.Tokenizer.from_file(path)
    for limit in (5, 1000):
        enc = g.ChunkEncoder(path, limit)
        for text, ids in zip(ODD, enc.encode(ODD)):
            assert np.frombuffer(ids, "<u4").tolist() == plain.encode(text or "", add_special_tokens=False).ids, text


def test_pack(spark):
    rows = [(i, t, "extra") for i, t in enumerate(ODD * 7)] + [(3, "twice", "x"), (3, "twice", "x"), (None, "no id", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, length string")
    got = g.pack(df).collect()
    plain = tokenizers.Tokenizer.from_file(g.tokenizer_path())
    want = Counter()
    for doc_id, text, _ in rows:
        ids = plain.encode(text or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), 4096):
            want[doc_id, k // 4096, k, len(ids[k:k + 4096]), zlib.crc32(np.array(ids[k:k + 4096], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 4096
    assert g.pack(df.limit(0)).count() == 0
