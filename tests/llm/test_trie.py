"""The conversation trie against a plain construction of every node."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tablewright.llm import conversation_trie as ct

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def plain_nodes(rows, rebuild=True):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [(r, x) for _, r, x in sorted(v, key=lambda t: t[0])] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6 if rebuild else 0
        built[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + turns[h:]
    members, children = defaultdict(list), defaultdict(set)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    for node in members:
        if node:
            children[node[:-1]].add(node)

    def subtree(node):
        todo = [node]
        while todo:
            at = todo.pop()
            todo.extend(children[at])
            yield at

    out = []
    for node, convs in members.items():
        below = list(subtree(node))
        ends = ",".join(map(str, sorted(c for c in convs if len(built[c]) == len(node))))
        out.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(children[node]), sum(not children[x] for x in below),
                    sum((len(members[x]) - 1) * len(x[-1][1]) for x in below if x), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(df, **options):
    return sorted(map(tuple, ct.prefix_trie(df, **options).collect()), key=str)


@pytest.mark.parametrize("block, rebuild", [(256, True), (4, True), (256, False)])
def test_equals_plain_nodes(spark, monkeypatch, block, rebuild):
    monkeypatch.setattr(ct, "BLOCK", block)
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "bb", "ccc", None, "dé"]))
            for c in range(520) if rng.random() > 0.1 for t in range(rng.choice([1, 1, 2, 3, 4, 9]))]
    rows += [(None, 1, "user", "no id"), (5000, None, "user", "first"), (5000, 0, "user", "then"), (-7, 0, "user", "a")]
    # Long paths whose shards share a deep spine, one path that many repeat, and a turn that many begin with.
    rows += [(c, t, "user", str(t % 7) if t < 90 + c % 5 else f"{c}") for c in range(900, 930) for t in range(100)]
    rows += [(c, t, "user", "same") for c in range(2000, 2090) for t in range(3)]
    rows += [(c, t, "user", "hello" if t == 0 else f"{c}") for c in range(3000, 3080) for t in range(2)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    assert found(df, rebuild=rebuild) == plain_nodes(rows, rebuild)


def test_empty_clashing_columns_ties_and_long_texts(spark):
    assert ct.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, 0, "u", "x" * 300_000), (1, 0, "u", "x" * 300_000), (2, 0, "u", "x" * 300_000), (3, None, None, None)]
    df = spark.createDataFrame([r + (9, b"k", 1) for r in rows], SCHEMA + ", path_key bigint, key binary, depth int")
    assert found(df) == plain_nodes(rows)
    assert found(df.unionAll(df).where("false")) == []


def test_ids_of_a_hot_path_are_hashed_in_order(spark, monkeypatch):
    monkeypatch.setattr(ct, "PIECE", 200)
    rows = [(c, 0, "u", "all alike") for c in range(3000)]
    got = found(spark.createDataFrame(rows, SCHEMA), rebuild=False)
    assert got == plain_nodes(rows, False)


def test_findclose_equals_a_stack():
    rng = np.random.default_rng(5)
    for n in (1, 2, 40, 3000):
        depths = [0]
        for _ in range(n - 1):
            depths.append(int(rng.integers(max(1, depths[-1] - 30), depths[-1] + 2)))
        tree, stack, closes, at = ct.Parentheses(np.array(depths)), [], [0] * n, 0
        for i, d in enumerate(depths + [0]):
            while stack and (i == n or depths[stack[-1]] >= d):
                closes[stack.pop()] = at
                at += 1
            stack.append(i)
            at += 1
        assert tree.findclose().tolist() == closes
