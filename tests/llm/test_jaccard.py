"""The Jaccard join against all pairs."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from conftest import SF
from scorewright.llm import jaccard, queries
from scorewright.llm.near import shingles

from .conftest import EDGE


def sets_of(text, words=3):
    parts = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {b" ".join(parts[i : i + words]) for i in range(len(parts) - words + 1)} if len(parts) > words else {b" ".join(parts)} if parts else set()


def compared(rows, percent=90):
    """(id, size, component) of rows by comparing all pairs that share a shingle."""
    sets = [(i, frozenset(sets_of(t))) for i, t in rows]
    top = {i: i for i, _ in sets}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    having = {}
    for k, (_, s) in enumerate(sets):
        for x in s:
            having.setdefault(x, []).append(k)
    for k, (i, s) in enumerate(sets):
        for m, both in Counter(m for x in s for m in having[x] if m < k).items():
            j, other = sets[m]
            if 100 * both >= percent * (len(s) + len(other) - both) and find(i) != find(j):
                top[max(find(i), find(j))] = min(find(i), find(j))
    return Counter((i, len(s), find(i) if s else i) for i, s in sets)


def result(df):
    return Counter((r.doc_id, r.n_shingles, r.component_id) for r in df.collect())


def planted(seed, groups=40, size=8):
    """Chains and stars of near copies around 0.9, of 5 to 300 words, and texts that share a long passage without linking."""
    rng = random.Random(seed)
    rows, word = [], lambda: f"w{rng.randrange(10**6)}"
    passage = [word() for _ in range(150)]
    for g in range(groups):
        here = [word() for _ in range(rng.choice([3, 5, 9, 10, 11, 20, 60, 150, 300]))]
        if g % 4 == 0:
            here = passage + here
        for _ in range(size):
            rows.append((len(rows), " ".join(here)))
            here = list(here)
            for _ in range(rng.randrange(1, 4)):
                at = rng.randrange(len(here) + 1)
                here[at : at + 1] = rng.choice([[word()], [], [*here[at : at + 1], word()]])
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("limit", [jaccard.LIMIT, 5])
def test_op13_all_pairs(spark, limit):
    """In tasks, and with regions so small that they are split by pivots over tasks and into tiles."""
    rows = planted(1)
    found = result(jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), limit=limit))
    want = compared(rows)
    assert found == want and 40 < len({c for _, _, c in want}) < len(rows)


def test_op13_whole_table(spark, texts):
    assert result(queries.op13_jaccard(spark, SF)) == compared(texts)


def test_op13_sql(assert_oracle):
    assert_oracle(queries.op13_jaccard, queries.ORACLE_SQL["op13_jaccard"])


def test_op13_keys(rng):
    """Sets that link have a key in common, at every size and share from the threshold up."""
    draw = np.random.default_rng(3)
    for size in [*range(1, 40), 57, 100, 101, 250, 999, 5000]:
        for _ in range(30 if size < 1000 else 3):
            both = draw.integers(0, 1 << 63, size, np.uint64)
            most = len(both) // 9  # so many at most can be in one of the two alone
            extra = draw.integers(0, 1 << 63, most, np.uint64)
            cut = rng.randrange(most + 1)
            x, y = (np.unique(np.concatenate([both, e])) for e in (extra[:cut], extra[cut:]))
            assert np.array_equal(x, y) or np.intersect1d(jaccard.part_keys(x), jaccard.part_keys(y)).size


def test_op13_sets_with_empty_parts():
    """Sets whose elements all fall into few parts go on to other partings, and link by one key in the end."""
    parts, seed = 3, 0
    pool = np.arange(1, 200_000, dtype=np.uint64)
    for seed in range(jaccard.SEEDS):
        pool = pool[(jaccard._mixed(pool, 2 * seed + 1) >> np.uint64(20)) % np.uint64(parts) == 0]
    x, y = pool[:10], pool[:11]
    assert len(y) == 11 and np.intersect1d(jaccard.part_keys(x), jaccard.part_keys(y)).size


def test_op13_region_of_one_kind(spark):
    """Many texts at the same distance of each other, just below the threshold, and some links among them."""
    rng = random.Random(2)
    base = [f"b{i}" for i in range(200)]
    rows = []
    for i in range(60):
        words = list(base)
        for at in rng.sample(range(0, 200, 10), 3):
            words[at] = f"x{rng.random()}"
        rows.append((i, " ".join(words)))
    want = compared(rows)
    for limit in (jaccard.LIMIT, 8):
        assert result(jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), limit=limit)) == want


def test_op13_edges(edge, empty, spark):
    found = Counter((r.doc_id, r.n_shingles) for r in jaccard.jaccard_join(edge).collect())
    assert found == Counter((i, len(sets_of(t))) for i, t in EDGE)
    parts = {r.doc_id: r.component_id for r in jaccard.jaccard_join(edge).collect()}
    assert parts[2] == 1 and parts[7] == 6 and parts[13] == parts[15] == 12 and parts[3] == 3 and parts[4] == 4 and parts[5] == 5 and parts[None] is None
    assert jaccard.jaccard_join(empty).count() == 0
    twice = spark.createDataFrame([(1, "a b c d"), (2, "e f g h"), (2, "a b c d"), (2, None), (3, "E F g h")], "doc_id long, text string")
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_join(twice).collect()} == {(1, 2, 1), (2, 2, 1), (2, 0, 2), (3, 2, 1)}


def test_op13_shingles():
    assert {len(shingles(t, 3)) for t in ("a", "a b", "a b c", "A  b\tc")} == {1} and len(shingles("", 3)) == 0
