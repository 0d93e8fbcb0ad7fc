import random

import pytest
from pyspark.sql import functions as F

from tablewright.config import Config
from tablewright.functions import token_sort_key
from tablewright.operators import similarity as sim
from tablewright.operators.rows import with_dense_index

WORDS = "red blue widget gear bolt small large service department national steel frame customer industrial".split()


def lcs(a, b):
    p = [0] * (len(b) + 1)
    for x in a:
        c = [0]
        for j, y in enumerate(b):
            c.append(p[j] + 1 if x == y else max(p[j + 1], c[j]))
        p = c
    return p[-1]


def score(a, b):
    return round(200 * lcs(a, b) / (len(a) + len(b))) if a or b else 100


def names(seed, n):
    rnd = random.Random(seed)

    def damage(s):
        s = list(s)
        for _ in range(rnd.randint(0, 5)):
            o, i = rnd.random(), rnd.randrange(max(1, len(s)))
            if o < .4 and s:
                s.pop(i)
            elif o < .8:
                s.insert(i, rnd.choice("abc xyz01"))
            elif s:
                s[i] = rnd.choice("abcdefgh")
        return "".join(s)

    base = [" ".join(rnd.choice(WORDS) for _ in range(rnd.randint(1, 10))) for _ in range(n // 9)]
    return [damage(rnd.choice(base)) for _ in range(n - 4)] + ["", "--", "same text", "same text"]


@pytest.fixture(scope="module")
def table(spark):
    values = names(11, 260)
    df = spark.createDataFrame(list(enumerate(values)), "_row_id bigint, name string")
    keys = [r[0] for r in df.orderBy("_row_id").select(token_sort_key(F.col("name"))).collect()]
    return df, keys


@pytest.mark.parametrize("threshold", [92, 85])
def test_similar_keys_lose_nothing(spark, table, threshold):
    keys = sorted(set(table[1]) - {""})
    expected = {}
    for i, a in enumerate(keys):
        for b in keys[i + 1:]:
            if min(len(a), len(b)) * 200 >= (threshold - 1) * (len(a) + len(b)):
                s = score(a, b)
                if s >= threshold:
                    expected[a, b] = s
    df = spark.createDataFrame([(k,) for k in keys], "key string")
    got = {(r.key_a, r.key_b): r.score for r in sim.similar_keys(df, threshold).collect()}
    assert got == expected and expected


def test_hot_groups_are_salted_without_loss(spark, table, monkeypatch):
    monkeypatch.setattr(sim, "GROUP_ROWS", 3)
    keys = sorted(set(table[1]) - {""})
    df = spark.createDataFrame([(k,) for k in keys], "key string")
    salted = {(r.key_a, r.key_b, r.score) for r in sim.similar_keys(df, 92).collect()}
    monkeypatch.undo()
    assert salted == {(r.key_a, r.key_b, r.score) for r in sim.similar_keys(df, 92).collect()}


def test_enough_chunks_for_every_length():
    for threshold in (80, 85, 92, 97):
        for low in (7, 17, 20):
            q = sim._chunk_size(low, 400, threshold)
            for n in range(low, 401):
                k = sim.allowed_edits(n + sim.longest_partner(n, threshold), threshold)
                assert n // q >= k + 1 or q == 1


@pytest.mark.parametrize("mode", ["greedy", "any_earlier"])
@pytest.mark.parametrize("window,blanks", [(20, False), (60, True)])
def test_window_flags(spark, table, mode, window, blanks):
    df, keys = table
    cfg = Config(near_duplicate_mode=mode, near_duplicate_window=window, blanks_match=blanks)
    flags = [False] * len(keys)
    for i, a in enumerate(keys):
        if mode == "greedy" and flags[i]:
            continue
        for j in range(i + 1, min(i + window, len(keys))):
            b = keys[j]
            if (a and b or blanks) and score(a, b) >= 92:
                flags[j] = True
    placed = with_dense_index(df.repartition(5), "_idx")
    got = {r._idx for r in sim.window_flags(placed, "name", "_idx", cfg, block_rows=64).collect()}
    assert got == {i for i, f in enumerate(flags) if f}


def test_greedy_with_one_name_everywhere(spark):
    df = spark.createDataFrame([(i, "same") for i in range(500)], "_row_id bigint, name string")
    cfg = Config(near_duplicate_window=7, near_duplicate_mode="greedy")
    out = sim.window_flags(with_dense_index(df, "_idx"), "name", "_idx", cfg, block_rows=100)
    kept = set(range(500)) - {r._idx for r in out.collect()}
    assert kept == set(range(0, 500, 7))


def test_flag_column_only_when_needed(spark):
    df = spark.createDataFrame([(1, "alpha"), (2, "omega centauri")], "_row_id bigint, name string")
    assert sim.flag_near_duplicates(df).columns == df.columns
    df = df.union(spark.createDataFrame([(3, "Alpha ")], "_row_id bigint, name string"))
    out = {r._row_id: r._near_duplicate for r in sim.flag_near_duplicates(df).collect()}
    assert out == {1: False, 2: False, 3: True}


def test_near_pairs_count_rows(spark):
    rows = [("John Smith",)] * 3 + [("smith john",)] + [("Jon Smith",)] * 2 + [("nobody else",), (None,)]
    out = sim.near_pairs(spark.createDataFrame(rows, "name string")).collect()
    assert [(r.a, r.b, r.score, r.rows_a, r.rows_b) for r in out] == [("John Smith", "Jon Smith", 95, 4, 2)]


def test_whole_table_flags_all_columns(spark):
    rows = [(i, f"item number {i % 40} {'abcdefghij'[i % 10] * 8}", "x" if i != 77 else "only a title here") for i in range(120)]
    rows += [(500, "zzzz qqqq", "only a titel here"), (501, "", None), (502, "", None)]
    df = spark.createDataFrame(rows, "_row_id bigint, name string, title string")
    got = {r._row_id for r in sim.flag_near_duplicates(df).filter("_near_duplicate").collect()}
    keys = [(i, *[" ".join(sorted((t or "").lower().split())) for t in texts]) for i, *texts in rows]

    def alike(a, b):
        if not a or not b:
            return False
        grid = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for x, ca in enumerate(a):
            for y, cb in enumerate(b):
                grid[x + 1][y + 1] = grid[x][y] + 1 if ca == cb else max(grid[x][y + 1], grid[x + 1][y])
        return round(200 * grid[-1][-1] / (len(a) + len(b))) >= 92

    want = {i for k, (i, a, b) in enumerate(keys) if any(alike(a, c) or alike(b, d) for _, c, d in keys[:k])}
    assert got == want and 500 in got


@pytest.mark.parametrize("threshold, blanks", [(92, False), (85, True)])
def test_greedy_flags_of_the_whole_table(spark, table, threshold, blanks):
    df, keys = table
    kept, want = [], []
    for k in keys:
        if k == "" and not blanks:
            want.append(False)
            continue
        alike = any(k == other or (k and other and score(k, other) >= threshold) for other in kept)
        want.append(alike)
        if not alike:
            kept.append(k)
    out = sim.flag_near_duplicates(df, Config(near_duplicate_mode="greedy", similarity_threshold=threshold, blanks_match=blanks))
    assert [r._near_duplicate for r in out.orderBy("_row_id").collect()] == want


def test_greedy_rounds(spark, monkeypatch):
    """A constant column needs no round; a chain, each like the next one only, is settled from its beginning."""
    rounds = []
    write = sim.write_table
    monkeypatch.setattr(sim, "write_table", lambda df: rounds.append(1) or write(df))
    same = spark.createDataFrame([(i, "one and the same name") for i in range(500)], "_row_id bigint, name string")
    flags = sim.flag_near_duplicates(same, Config(near_duplicate_mode="greedy"))
    assert flags.filter("_near_duplicate").count() == 499 and len(rounds) == 1
    text = "abcdefghijklmnopqrstuvwxyz0123456789"
    chain = [text[:i] + text[i + 2:] if i else text for i in range(0, 16, 2)]
    df = spark.createDataFrame(list(enumerate(chain)), "_row_id bigint, name string")
    kept, want = [], []
    for k in chain:
        want.append(any(score(k, other) >= 92 for other in kept))
        kept += [] if want[-1] else [k]
    assert [r._near_duplicate for r in sim.flag_near_duplicates(df, Config(near_duplicate_mode="greedy")).orderBy("_row_id").collect()] == want


def test_first_alikes_build_no_pairs(spark, table):
    """Short keys: as many joined rows as subsequences, whatever the number of alike keys."""
    df, keys = table
    firsts = {}
    for i, k in enumerate(keys):
        firsts.setdefault(k, i)
    want = {k: min([f, *(firsts[o] for o in firsts if o and k and score(o, k) >= 92)]) for k, f in firsts.items() if k}
    got = {r.key: r.first for r in sim.first_alikes(df, "name", "_row_id").collect()}
    assert got == want
    many = spark.createDataFrame([(i, f"item {i:05d}") for i in range(3000)], "_row_id bigint, name string")
    plan = sim.first_alikes(many, "name", "_row_id")._jdf.queryExecution().toString()
    assert "key_a" not in plan


def _joins(df):
    """The joins that Spark plans before it has seen any row."""
    return [n for n in df._jdf.queryExecution().sparkPlan().toString().split() if n.endswith("HashJoin") or n.endswith("MergeJoin")]


def test_exploded_keys_are_never_broadcast(spark, tmp_path):
    """Small compressed files may hold many keys, and each key is exploded into many rows."""
    path = str(tmp_path / "names")
    long = ["a much longer name of many words than the limit " + str(i % 7) for i in range(40)]
    names = [f"Customer#{i:09d}" for i in range(40)] + long
    spark.createDataFrame([(n, i) for i, n in enumerate(names)], "name string, row bigint").write.parquet(path)
    df = spark.read.parquet(path)
    for out in (sim.near_pairs(df), sim.first_alikes(df, "name", "row")):
        joins = _joins(out)
        assert joins and not [j for j in joins if j.startswith("Broadcast")], joins
