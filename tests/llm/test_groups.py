import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from gristmill.llm import components, splits
from gristmill.plans.shared import Scratch

DOCS, LINKS, ALIASES = "id bigint, group_id string, split string", "left_id bigint, right_id bigint, jaccard double", "external_group string, group_id string"
PREPARATION = "near_duplicate_jaccard double, train_ratio double, validation_ratio double, test_ratio double"


def prepared(spark, rows=((0.85, 0.9, 0.05, 0.05),)):
    return spark.createDataFrame(list(rows), PREPARATION)


def brute(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            root[x] = y
    groups = defaultdict(set)
    for n in root:
        groups[find(n)].add(n)
    return {frozenset(g) for g in groups.values()}


def grouped(rows):
    groups = defaultdict(set)
    for r in rows:
        groups[r["root"]].add(r["v"])
    return {frozenset(g) for g in groups.values()}


CASES = {
    "empty": [], "loops": [(1, 1), (2, 2)], "chain": [(i, i + 1) for i in range(400)], "star": [(0, i) for i in range(1, 300)], "ring": [(i, (i + 1) % 50) for i in range(50)],
    "nulls": [(None, 1), (1, None), (1, 2), (None, None)], "repeats": [(3, 1), (1, 3), (3, 1), (5, 4)], "negative": [(-5, 3), (-5, -7), (9, -1)],
    "random": [(random.Random(i).randint(0, 300), random.Random(i + 10_000).randint(0, 300)) for i in range(220)],
}


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("rounds", [1, 3])
def test_components(spark, case, rounds):
    found = components.components(spark.createDataFrame(CASES[case], "a bigint, b bigint"), Scratch(spark, "t"), rounds=rounds)
    rows = found.collect()
    assert grouped(rows) == brute(CASES[case])
    assert len({r["v"] for r in rows}) == len(rows) and all(r["root"] in {x["v"] for x in rows} for r in rows)


def label(n):
    return f"{n:064x}"


def test_ties(spark):
    docs = [(1, label(1), "a"), (2, label(2).upper() + " ", "a"), (2, label(3), "b"), (3, "unassigned", None), (4, None, None), (5, label(5), ""), (6, " " + label(3), "x"), (7, label(9)[:-1], None), (None, label(1), None), (8, label(8), None), (10, label(10), None), (11, label(10), None)]
    links = [(4, 3, 0.9), (3, 3, 1.0), (5, 99, 0.85), (99, 1, 0.86), (8, 7, 0.8), (8, 7, None), (8, 7, float("nan")), (None, 8, 1.0)]
    aliases = [("S:É/1 ", label(8)), ("s:é/1", label(77)), ("t:2", label(77)), ("T:2", label(10)), ("s:", label(1)), ("s:  ", label(8)), (None, label(1)), ("x:1", None), ("noprefix", label(4)), (":x", label(1)), ("u:1", "unassigned"), ("v:9", label(8)), ("v:9", label(8))]
    frames = [spark.createDataFrame(docs, DOCS).selectExpr("*", "1 as root", "'x' as label"), spark.createDataFrame(links, LINKS), spark.createDataFrame(aliases, ALIASES)]
    got = {r["id"]: r["root_id"] for r in components.record_groups(*frames, prepared(spark)).collect()}
    assert got == {1: 1, 5: 1, 2: 2, 6: 2, 3: 3, 4: 3, 7: 7, 8: 8, 10: 8, 11: 8}


def test_empty_tables(spark):
    docs, links, aliases = (spark.createDataFrame([], s) for s in (DOCS, LINKS, ALIASES))
    assert components.record_groups(docs, links, aliases, prepared(spark, ())).count() == 0
    assert splits.group_splits(docs, links, aliases, prepared(spark, ())).count() == 0
    one = spark.createDataFrame([(1, label(1), None), (2, label(1), "Test")], DOCS)
    assert {r["root_id"] for r in components.record_groups(one, links, aliases, prepared(spark, ())).collect()} == {1}
    assert {r["split"] for r in splits.group_splits(one, links, aliases, prepared(spark, ())).collect()} == {"train"}


@pytest.mark.parametrize("seed", range(5))
def test_differencing_balances(seed):
    drawn = random.Random(seed)
    weights, bins = [drawn.randint(1, 1000) for _ in range(300)], 12
    where, sums = splits.difference(weights, bins)
    held = np.zeros(bins, dtype=int)
    np.add.at(held, where, weights)
    assert (held == sums).all() and sums.max() - sums.min() <= max(weights) / 10


def test_differencing_small():
    assert sorted(splits.difference([8, 7, 6, 5, 4], 2)[1].tolist()) == [14, 16]  # the classic example
    assert splits.difference([], 3)[1].tolist() == [0, 0, 0] and splits.difference([5], 3)[1].sum() == 5


@pytest.mark.parametrize("histogram", [{}, {1: 1}, {1: 1000}, {1: 50, 900: 1}, {5: 3, 2: 7, 1: 11, 100: 2}, {1000: 300}])
def test_plan_places_every_group_once(histogram):
    taken, even_bins, sums = splits.plan(dict(histogram), 20)
    assert sums.sum() == sum(w * c for w, c in histogram.items()) and 1 <= even_bins <= 20
    held = np.zeros(20, dtype=int)
    for w, c in histogram.items():
        even, further = taken[w]
        assert even % even_bins == 0 and even + len(further) == c
        held[:even_bins] += w * even // even_bins
        np.add.at(held, further, w)
    assert (held == sums).all()


def test_splits(spark, monkeypatch):
    monkeypatch.setattr(splits, "BUCKET", 40)  # several buckets of ranks, as in a large table
    drawn = random.Random(2)
    sizes = [1] * 500 + [drawn.randint(2, 9) for _ in range(60)] + [100]
    docs = [(1000 * g + i, label(g), drawn.choice(["train", " Train", "TRAIN", "val" if g % 50 == 0 else "train", None, " "])) for g, n in enumerate(sizes) for i in range(n)]
    docs += docs[:30]
    empty = spark.createDataFrame([], LINKS), spark.createDataFrame([], ALIASES)
    rows = splits.group_splits(spark.createDataFrame(docs, DOCS), *empty, prepared(spark), bins=60).collect()
    assert len(rows) == len({d[0] for d in docs}) == len({r["id"] for r in rows})
    of = defaultdict(set)
    for r in rows:
        of[r["root_id"]].add((r["split"], r["bin"], r["torn"]))
    assert all(len(v) == 1 for v in of.values())
    share = Counter(r["split"] for r in rows)
    for name, ratio in (("train", 0.9), ("validation", 0.05), ("test", 0.05)):
        assert abs(share[name] / len(rows) - ratio) < 0.02
    now = defaultdict(set)
    for i, g, s in docs:
        if s and s.strip():
            now[g].add({"val": "validation"}.get(s.strip().lower(), s.strip().lower()))
    torn = {i for i, g, _ in docs if len(now[g]) > 1}
    assert torn == {r["id"] for r in rows if r["torn"]}
    again = splits.group_splits(spark.createDataFrame(docs, DOCS).repartition(5), *empty, prepared(spark), bins=60).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))


def test_one_group_holds_everything(spark):
    docs = spark.createDataFrame([(i, label(1), "train") for i in range(50)], DOCS)
    rows = splits.group_splits(docs, spark.createDataFrame([], LINKS), spark.createDataFrame([], ALIASES), prepared(spark)).collect()
    assert {(r["split"], r["root_id"], r["torn"]) for r in rows} == {("train", 0, False)}


@pytest.mark.parametrize("far", [0, 1])
def test_negative_ids_are_no_labels(spark, far):
    """An alias key ties the label of a record to one that no record has; records of negative ids stay by themselves."""
    low = -(1 << 63) if far else -2
    docs = spark.createDataFrame([(-1, None, None), (low, label(7), None), (5, label(5), None)], DOCS)
    aliases = spark.createDataFrame([("s:1", label(5)), ("s:1", label(6)), ("s:2", label(6)), ("s:2", label(8))], ALIASES)
    got = {r["id"]: r["root_id"] for r in components.record_groups(docs, spark.createDataFrame([], LINKS), aliases, prepared(spark)).collect()}
    assert got == {-1: -1, low: low, 5: 5}


def test_many_left_over_groups_stay_cheap():
    import tracemalloc

    histogram = {w: 199 for w in range(1, 600)}
    tracemalloc.start()
    taken, even_bins, sums = splits.plan(histogram, 200)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6 and sums.sum() == sum(w * c for w, c in histogram.items()) and sums.max() - sums.min() < 20
