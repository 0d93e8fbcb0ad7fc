"""SimHash tiles against all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash

from tablewright.llm import simhash_tiles as s


def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), (text or "").encode()))
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(x, seed=42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(points, radius=3):
    root = {p: p for p in points}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    points = list(points)
    for i, a in enumerate(points):
        for b in points[:i]:
            if (a ^ b).bit_count() <= radius:
                root[find(a)] = find(b)
    return {p: find(p) for p in points}


@pytest.mark.parametrize("text", [None, "", "one", "two Words", "Three words HERE", "É é   x y", "a b c " * 500, "the cat sat on the mat and the cat sat"])
def test_fingerprint(text, monkeypatch):
    assert s.fingerprint(text) == plain_fingerprint(text)
    monkeypatch.setattr(s, "CHUNK", 7)
    assert s.fingerprint(text) == plain_fingerprint(text)


def clusters(rng, n, flips=3):
    out = set()
    for _ in range(n):
        p = rng.getrandbits(64)
        for _ in range(rng.randint(1, 6)):
            for _ in range(rng.randint(0, flips)):
                p ^= 1 << rng.randrange(64)
            out.add(p)
    return out


def test_forest_spans_all_links():
    rng = random.Random(3)
    points = clusters(rng, 60)
    a, b = s.forest(np.array(sorted(points), np.uint64), 3)
    assert all((int(x) ^ int(y)).bit_count() <= 3 for x, y in zip(a, b))
    want = brute_components(points)
    assert len(a) == len(points) - len(set(want.values()))


@pytest.mark.parametrize("tile", [3, 2048])
def test_components_equal_all_pairs(spark, tile):
    rng = random.Random(5)
    points = clusters(rng, 80)
    # A dense ball: most of it shares blocks, so small tiles must be split.
    centre = rng.getrandbits(64)
    points |= {centre ^ (1 << i) ^ (1 << j) for i in range(12) for j in range(12)}
    signed = [p - (1 << 64) if p >> 63 else p for p in points]
    links = s.near_links(spark.createDataFrame([(p,) for p in signed], "fp bigint"), tile=tile)
    roots = {r.node & (1 << 64) - 1: r.root & (1 << 64) - 1 for r in s.components(links).collect()}
    want = brute_components(points)
    label = {p: roots.get(p, p) for p in points}
    assert len(set(zip(want.values(), [label[p] for p in want]))) == len(set(want.values())) == len(set(label.values()))


def test_long_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)], "a bigint, b bigint")
    assert {(r.node, r.root) for r in s.components(chain).collect() if r.node} == {(i, 0) for i in range(1, 201)}


def test_near_groups(spark):
    rng = random.Random(8)
    base = [" ".join(rng.choice("abcdefghij") * rng.randint(1, 4) for _ in range(60)) for _ in range(25)]
    rows = []
    for i, t in enumerate(base * 4):
        words = t.split()
        if i >= 50:
            words[rng.randrange(60)] = "changed"
        rows.append((i, " ".join(words), "x"))
    rows += [(900, None, "x"), (901, "", "x"), (None, base[0], "x"), (3, base[3].upper(), "x"), (902, " \t", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, fp string")
    got = s.near_groups(df).collect()
    assert len(got) == len(rows)
    fps = {r[1]: plain_fingerprint(r[1]) for r in rows}
    comps = brute_components(set(fps.values()))
    low = {}
    for doc_id, text, _ in rows:
        if doc_id is not None:
            c = comps[fps[text]]
            low[c] = min(low.get(c, doc_id), doc_id)
    by_id = {}
    for doc_id, text, _ in rows:
        by_id.setdefault(doc_id, set()).add((f"{fps[text]:016x}", low[comps[fps[text]]]))
    assert all((r.fingerprint, r.component_id) in by_id[r.doc_id] for r in got)
    kept = s.drop_near_copies(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(low.values()))


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert s.near_groups(empty).count() == 0
    assert s.drop_near_copies(empty).count() == 0


def test_repeated_and_null_ids_keep_each_text(spark):
    rng = random.Random(21)
    texts = [" ".join(rng.choice("abcdefghij") * rng.randint(1, 6) for _ in range(80)) for _ in range(9)]
    rows = [(None, t) for t in texts[:4]] + [(5, t) for t in texts[4:7]] + [(6, texts[7]), (7, texts[7]), (7, texts[8]), (None, texts[8]), (5, texts[4])]
    kept = s.drop_near_copies(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    want = [(None, t) for t in texts[:4]] + [(5, t) for t in texts[4:7]] + [(6, texts[7]), (7, texts[8])]
    assert sorted(map(str, map(tuple, kept))) == sorted(map(str, want))
