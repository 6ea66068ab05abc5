import random
from itertools import combinations

import pytest
from conftest_llm import corpus, table

from unitloom.llm import components, neardup


def brute(texts, size, percent):
    def shingles(text):
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
        if not words:
            return set()
        return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} or {tuple(words)}

    sets = [shingles(t) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(range(len(texts)), 2):
        if sets[a] and sets[b]:
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return [(i, len(s), find(i), find(i) == i) for i, s in enumerate(sets)]


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_groups_equal_brute_force(spark, size, percent):
    texts = corpus(7, 250)
    got = sorted(map(tuple, neardup.near_duplicates(table(spark, texts), size, percent).collect()))
    assert got == brute(texts, size, percent)


def test_large_group_of_near_copies(spark):
    base = [f"w{i}" for i in range(120)]
    texts = [" ".join(base)] + [" ".join(base[:k] + [f"x{k}"] + base[k + 1 :]) for k in range(1, 119)]
    got = sorted(map(tuple, neardup.near_duplicates(table(spark, texts), 3, 85).collect()))
    assert {r[2] for r in got} == {0} and [r[0] for r in got if r[3]] == [0]


def variants(own, base, n, changes=6):
    """Copies of base with so many words changed, each in places and to words of its own."""
    for i in range(n):
        words = list(base)
        for k in own.sample(range(len(base)), changes):
            words[k] = f"v{i}x{k}"
        yield " ".join(words)


def test_star_of_many_variants(spark):
    # Each variant is linked with the base and with hardly any other; the base meets a few alone.
    base = [f"w{i}" for i in range(300)]
    texts = [" ".join(base), *variants(random.Random(3), base, 1000)]
    _, of = neardup.groups(table(spark, texts), 3, 85, reach=2)
    assert {r.id: r.component for r in of.collect()} == dict.fromkeys(range(1001), 0)


def test_links_beyond_a_full_window(spark):
    # No base, so the variants are apart, but for pairs that a narrow window passes by.
    base, own = [f"w{i}" for i in range(200)], random.Random(4)
    texts = list(variants(own, base, 60, 7))
    for k in range(10):
        texts.append(texts[k].replace("w100 ", f"y{k} ").replace("w150 ", f"z{k} "))
    signed, of = neardup.groups(table(spark, texts), 3, 85, reach=1)
    got = {r.id: r.component for r in of.collect()}
    want = {i: c for i, _, c, _ in brute(texts, 3, 85)}
    assert {i: got.get(i, i) for i in want} == want and len(set(want.values())) < len(texts)


def boilerplate_pairs(n):
    """Pairs of documents at 0.863 that all share a long text, by which all others are at 0.847."""
    base = " ".join(f"b{i}" for i in range(102))
    tail = lambda k, m: " ".join(f"t{k}x{j}" for j in range(m))
    out = []
    for k in range(n):
        out += [f"{base} {tail(k, 9)}", f"{base} {tail(k, 7)} u{k} v{k}"]
    return out


def test_pairs_among_others_just_below_the_threshold(spark):
    texts = boilerplate_pairs(1000)
    sets = [set(zip(w, w[1:], w[2:], strict=False)) for w in map(str.split, texts[:4])]
    share = lambda a, b: 100 * len(a & b) / len(a | b)
    assert share(sets[0], sets[1]) >= 85 > share(sets[0], sets[2])
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(table(spark, texts), 3, 85).collect()}
    assert got == {i: i - i % 2 for i in range(2000)}


def test_exact_pairs_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SALT_ROWS", 2)
    own = random.Random(6)
    rows = []
    for i in range(120):
        base = set(range(0, 40)) if i % 3 else set(range(100, 130))
        gone = own.sample(sorted(base), own.randint(0, 4))
        rows.append((i, i % 7, sorted(base - set(gone) | {1000 + own.randrange(30) for _ in range(own.randint(0, 3))})))
    sets = spark.createDataFrame(rows, "rep long, component long, s array<long>").repartition(3)
    got = {(r.a, r.b) for r in neardup.exact_pairs(sets, 85).collect()}
    want = set()
    for (i, c, a), (j, d, b) in combinations([(i, c, set(s)) for i, c, s in rows], 2):
        if c != d and 100 * len(a & b) >= 85 * len(a | b):
            want.add((i, j))
    assert want and want <= got and len(got) < 120 * 119 / 2


@pytest.mark.parametrize("rows", [1 << 16, 128])
def test_seams_between_partitions(spark, monkeypatch, rows):
    monkeypatch.setattr(neardup, "SEAM_ROWS", rows)
    texts = [f"common start of a text {i // 2} with words {i // 2} that pair up" for i in range(60)]
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        got = sorted(map(tuple, neardup.near_duplicates(table(spark, texts), 3, 85).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert got == brute(texts, 3, 85)


def test_odd_rows(odd):
    got = sorted(map(tuple, neardup.near_duplicates(odd, 3, 85).collect()), key=str)
    by = {}
    for i, n, c, k in got:
        by.setdefault(i, []).append((n, c, k))
    assert len(got) == 9
    assert by[None] == [(0, None, True), (2, None, True)] and by[1] == [(0, 1, True)] and by[2] == [(0, 2, True)]
    assert by[4] == [(2, 4, True)] * 2 and sorted(by[5]) == [(1, 5, True), (2, 4, False)]
    kept = neardup.keep_one(odd, 3, 85)
    assert kept.columns == odd.columns and kept.where("doc_id = 5").count() == 2 and kept.where("doc_id is null").count() == 2


def test_empty(none):
    assert neardup.near_duplicates(none).count() == 0


@pytest.mark.parametrize("split", [0, 2_000_000])
def test_components(spark, monkeypatch, split):
    monkeypatch.setattr(components, "SPLIT_EDGES", split)
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 102), (102, 101), (7, 7), (200, 200)] + [(300, 300 + k) for k in range(1, 50)]
    got = {r.id: r.component for r in components.components(spark.createDataFrame([*edges, (None, 3)], "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 104)} | {i: 300 for i in range(300, 350)}


def tasks_of(spark, run):
    """What run() returns, and how many tasks Spark started for it."""
    context = spark.sparkContext
    tracker, group = context.statusTracker(), f"tasks-{random.random()}"
    context.setJobGroup(group, "")
    try:
        out = run()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
    return out, sum(i.numTasks for s in stages if (i := tracker.getStageInfo(s)))


def test_small_graph_takes_few_tasks(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    got, tasks = tasks_of(spark, lambda: components.components(path).collect())
    assert {r.id: r.component for r in got} == dict.fromkeys(range(201), 0) and tasks <= 40


@pytest.mark.parametrize("n", [1, 60, 400])
def test_small_graphs_equal_rounds(spark, monkeypatch, n):
    own = random.Random(n)
    edges = spark.createDataFrame([(own.randrange(-n, n), own.randrange(-n, n)) for _ in range(n)], "a long, b long")
    ours = sorted(map(tuple, components.components(edges).collect()))
    monkeypatch.setattr(components, "LOCAL_EDGES", -1)
    assert ours == sorted(map(tuple, components.components(edges).collect()))


@pytest.mark.parametrize("split", [0, 2_000_000])
def test_rounds_of_a_large_graph(spark, monkeypatch, split):
    monkeypatch.setattr(components, "LOCAL_EDGES", -1)
    test_components(spark, monkeypatch, split)


def test_no_signature_is_held_on_to(spark):
    signed, _ = neardup.groups(table(spark, ["a b c d", "a b c d", "e f g h"]), 3, 85)
    assert signed.columns == ["doc_id", "n_shingles", "set_key"] and signed.count() == 3
