"""The pipeline's near duplicates: recall on planted pairs, and nothing linked below 0.8."""

from __future__ import annotations

import random

import numpy as np
from conftest import SF
from scorewright.llm import near, simhash, stages

from .conftest import EDGE

LEVELS = (0.80, 0.85, 0.90)
PAIRS = 60


def share(a, b):
    x, y = (({" ".join(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 5 else {" ".join(w)} if w else set()) for w in (a.lower().split(), b.lower().split()))
    return len(x & y) / len(x | y) if x | y else 1.0


def edited(words, level, rng):
    """A copy with words replaced at random places, as far down as `level` allows."""
    best = list(words)
    places = list(range(len(words)))
    rng.shuffle(places)
    for place in places:
        tried = best[:place] + [f"new{rng.random()}"] + best[place + 1 :]
        if share(" ".join(words), " ".join(tried)) < level:
            return best
        best = tried
    return best


def planted():
    rng = random.Random(5)
    rows, pairs = [], {}
    for level in LEVELS:
        for n in range(PAIRS):
            words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(100, 400))]
            i = 10 * len(rows)
            rows += [(i, " ".join(words)), (i + 1, " ".join(edited(words, level, rng)))]
            pairs[i] = level
        for n in range(PAIRS):  # just below: both stay
            words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(100, 400))]
            other = list(words)
            while share(" ".join(words), " ".join(other)) >= 0.8:
                other[rng.randrange(len(other))] = f"new{rng.random()}"
            i = 10 * len(rows)
            rows += [(i, " ".join(words)), (i + 1, " ".join(other))]
            pairs[i] = 0.0
    return rows, pairs


def test_recall_on_planted_pairs(spark):
    rows, pairs = planted()
    left = {r.doc_id for r in stages.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()}
    assert all(i in left for i in pairs)
    for level in LEVELS:
        caught = sum(i + 1 not in left for i, at in pairs.items() if at == level)
        assert caught >= 0.95 * PAIRS, (level, caught)
    assert all(i + 1 in left for i, at in pairs.items() if at == 0.0)


def test_whole_table_by_brute_force(spark, texts):
    """On the small table the kept documents are those of comparing every set with every other."""
    sets = {i: frozenset(" ".join(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) > 5 else frozenset([" ".join(w)] if w else []) for i, t in texts for w in [t.encode().lower().decode().split()]}
    top = {i: i for i in sets}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if (5 * len(x & y) >= 4 * len(x | y)) and find(a) != find(b):
                top[max(find(a), find(b))] = min(find(a), find(b))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    assert {r.doc_id for r in stages.drop_near_duplicates(spark, docs, SF).collect()} == {i for i in ids if find(i) == i}


def test_large_group(spark):
    """Many texts near one, more than go through one task, and some that only hang on through another."""
    rng = random.Random(9)
    base = [f"w{rng.randrange(5000)}" for _ in range(200)]
    rows = []
    for i in range(1500):
        words = list(base)
        words[rng.randrange(200)] = f"new{i}"
        rows.append((i, " ".join(words)))
    step = list(base)  # away from the base word by word: each step near the one before
    for k in range(12):
        for place in range(16 * k, 16 * k + 6):
            step[place] = f"far{k}.{place}"
        rows.append((2000 + k, " ".join(step)))
    found = {r.doc_id: r.component_id for r in near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    linked = {0}
    sets = {i: frozenset(near.shingles(t).tolist()) for i, t in rows}
    todo = [0]
    while todo:
        here = sets[todo.pop()]
        fresh = [i for i, s in sets.items() if i not in linked and 5 * len(here & s) >= 4 * len(here | s)]
        linked.update(fresh)
        todo += fresh[:20] if len(fresh) > 100 else fresh
    assert sum(i >= 2000 for i in linked) > 1
    assert all(found[i] == 0 for i in linked)


def test_fingerprints_differ_by_angle():
    """Sets that agree in 0.8 differ in about the share of bits that their angle says."""
    rng = np.random.default_rng(4)
    sets = []
    for _ in range(50):
        pool = np.unique(rng.integers(0, 1 << 63, 1000).astype(np.uint64))
        rng.shuffle(pool)
        sets += [np.sort(pool[:900]), np.sort(pool[100:1000])]
    bits = near.wide_fingerprints(sets)
    share = (bits[::2] != bits[1::2]).mean()
    assert abs(share - np.arccos(800 / 900) / np.pi) < 0.01 and abs(bits.mean() - 0.5) < 0.02


def test_edges(edge, empty):
    found = [(r.doc_id, r.component_id) for r in near.near_duplicates(edge).collect()]
    assert sorted(i for i, _ in found) == sorted(i for i, _ in EDGE if i is not None)
    top = dict(found)
    assert top[2] == 1 and top[5] == top[4] == 3 and top[7] == 6 and top[15] == top[13] == 12
    left = near.drop_near_duplicates(edge)
    assert left.columns == edge.columns and sum(r.doc_id is None for r in left.collect()) == 2
    assert near.near_duplicates(empty).count() == 0 and near.drop_near_duplicates(empty).count() == 0


def test_op6_leaves_the_session_as_it_was(spark):
    """Spark's own classifiers work in the session after op6 has run in it."""
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.linalg import Vectors

    rows = spark.createDataFrame([(i, f"some words {i // 2} and more of them") for i in range(20)], "doc_id long, text string")
    assert simhash.near_duplicates(rows).count() == 20
    table = spark.createDataFrame([(float(i % 2), Vectors.dense([i % 2, i])) for i in range(40)], ["label", "features"])
    for learner in (RandomForestClassifier(numTrees=3, seed=1), LogisticRegression()):
        assert learner.fit(table).transform(table).select("prediction").distinct().count() == 2


def test_components_make_no_round_for_stars(spark):
    """Links that are stars already take four jobs or fewer a table and plan; a round only to see that nothing changes took more."""
    stars = spark.createDataFrame([(10 * i + k, 10 * i) for i in range(5) for k in range(1, 4)] + [(11, 10)], "a long, b long")
    spark.sparkContext.setJobGroup("stars", "stars")
    try:
        found = {(r.node, r.root) for r in simhash.components(stars).collect()}
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("stars"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert found == {(10 * i + k, 10 * i) for i in range(5) for k in range(1, 4)}
    assert jobs <= 8


def test_components_of_random_links(spark, rng):
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)]
    top = {}

    def root(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        top[y] = x
    expected = {(x, root(x)) for x in top if root(x) != x}
    assert {(r.node, r.root) for r in simhash.components(spark.createDataFrame(links, "a long, b long")).collect()} == expected
