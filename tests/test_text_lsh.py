"""Near copies of long texts against all pairs."""

import random

from tablewright.config import Config
from tablewright.operators import similarity, text_lsh as tl
from tablewright.operators.rows import ROW_ID

SCHEMA = "doc_id bigint, text string"


def word_sets(rows):
    out = []
    for _, text in rows:
        words = (text or "").lower().split()
        out.append({tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))})
    return out


def all_pairs(rows):
    """(links, groups) of brute force: pairs of positions, and the smallest id of each row's group."""
    sets, root, links = word_sets(rows), list(range(len(rows))), set()

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b):
                links.add((j, i))
                root[find(i)] = find(j)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(find(i), []).append(r[0])
    return links, {r[0]: min(groups[find(i)]) for i, r in enumerate(rows)}


def planted(rng, copies=25, around=120):
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7)))
    passage, texts = [word() for _ in range(120)], []
    for _ in range(copies):
        base = [word() for _ in range(rng.randint(40, 200))]
        texts.append(base)
        for _ in range(rng.randint(0, 3)):
            copy = list(base)
            for _ in range(rng.randint(0, 5)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(copy)
    # Many that share a passage and are otherwise unlike: a bucket of thousands of unlike members in small.
    texts += [passage[:rng.randint(60, 120)] + [word() for _ in range(rng.randint(0, 60))] for _ in range(around)]
    rng.shuffle(texts)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    return rows + [(7000, None), (7001, ""), (7002, " \t"), (7003, "One two"), (7004, "one TWO"), (7005, "w " * 30_000), (7006, "w " * 30_001)]


def test_groups_and_recall(spark):
    rows = planted(random.Random(31))
    links, groups = all_pairs(rows)
    got = {r.doc_id: r for r in tl.near_text_groups(spark.createDataFrame(rows, SCHEMA).repartition(5), "doc_id", "text").collect()}
    sizes = {}
    for r in got.values():
        sizes[r.group_id] = sizes.get(r.group_id, 0) + 1
    assert all(r.group_rows == sizes[r.group_id] for r in got.values())
    # Nothing unlike is joined, and at least 0.9 of all linked pairs end in one group.
    assert all(groups[r.group_id] == groups[d] for d, r in got.items())
    ids = [r[0] for r in rows]
    together = sum(got[ids[a]].group_id == got[ids[b]].group_id for a, b in links)
    assert len(links) > 100 and together >= 0.9 * len(links), (together, len(links))


def test_candidates_stay_linear_in_a_bucket_of_unlike_members(spark):
    rng = random.Random(3)
    passage = " ".join(f"p{i}" for i in range(80))
    counts = []
    for n in (200, 800):
        rows = [(i, passage + " " + " ".join(f"x{rng.randrange(10**9)}" for _ in range(20))) for i in range(n)]
        docs = tl.with_signatures(spark.createDataFrame(rows, SCHEMA), "doc_id", "text")
        counts.append(tl.candidates(docs, radius=120).count())
    assert counts[1] <= 3 * tl.BANDS * 800 and counts[1] < 6 * counts[0]


def test_nulls_repeated_ids_and_empty_table(spark):
    rows = [(None, "a b c d e f"), (None, "u v w x y z"), (3, "g h i j k l"), (3, "m n o p q r"), (2, "A b c d e f"), (4, None)]
    got = tl.near_text_groups(spark.createDataFrame([r + (1,) for r in rows], SCHEMA + ", key int"), "doc_id", "text").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(None, 2, 2), (2, 2, 2), (None, None, 1), (3, 3, 1), (3, 3, 1), (4, 4, 1)]))
    assert tl.near_text_groups(spark.createDataFrame([], SCHEMA), "doc_id", "text").count() == 0


def test_flag_mode(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(1, base), (2, "quite another text"), (3, base.replace("w30", "other")), (4, base.upper())]
    df = spark.createDataFrame(rows, f"{ROW_ID} bigint, title string")
    flagged = similarity.flag_near_duplicates(df, Config(near_duplicate_mode="lsh"))
    assert {r[ROW_ID]: r._near_duplicate for r in flagged.collect()} == {1: False, 2: False, 3: True, 4: True}
