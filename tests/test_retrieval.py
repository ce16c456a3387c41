"""Searches against plain loops, in blocks of any size."""

from __future__ import annotations

import random

import pytest

from scorewright.operators import retrieval


@pytest.mark.parametrize("block", [2048, 7])
def test_posts_by_brute_force(spark, block):
    rng = random.Random(5)
    words = ["headphone", "audio", "budget", "lamp", "chair", "noise", "red", "pot", "zz"]
    text = lambda k: " ".join(rng.choice(words) for _ in range(k))
    posts = [(f"u{rng.randrange(50):02d}", rng.choice(["headphones", "technology", "news", "personalfinance", None]), text(2), text(rng.randrange(4)) or None) for _ in range(70)]
    queries = [(i, text(rng.randrange(0, 4)) or None) for i in range(30)]
    found = {}
    for r in retrieval.search_posts(spark.createDataFrame(queries, "query_id int, query string"), spark.createDataFrame(posts, "url string, forum string, title string, summary string"), 5, block=block).collect():
        found.setdefault(r.query_id, []).append((r.place, r.url, round(r.score, 9)))
    for i, query in queries:
        asked = [w for w in (query or "").split() if len(w) > 2]
        hinted = {f for word, forums in retrieval.HINTS.items() if word in (query or "") for f in forums}
        best = {}
        for url, forum, title, summary in posts:
            hay = f"{title} {summary or ''}"
            score = min(1.0, (sum(w in hay for w in asked) / len(asked) if asked else 0.0) + (0.5 if forum in hinted else 0.0))
            if score > 0:
                best[url] = max(best.get(url, 0.0), score)
        want = sorted(best.items(), key=lambda x: (-round(x[1], 9), x[0]))[:5]
        assert sorted(found.get(i, [])) == [(k + 1, u, round(s, 9)) for k, (u, s) in enumerate(want)]


@pytest.mark.parametrize("embedded", [False, True])
@pytest.mark.parametrize("block", [2048, 9])
def test_recall_by_brute_force(spark, embedded, block):
    rng = random.Random(6)
    vector = lambda: [rng.choice([-1.0, 0.0, 1.0, 2.0]) for _ in range(3)] if embedded and rng.random() < 0.7 else None
    memory = [(f"t{i:02d}", rng.choice(["causal", "timeline", "comparison"]), rng.choice([None, 0.0, 0.25, 0.5, 0.75]), vector()) for i in range(60)]
    kind = "task_id string, intent_type string, best double, embedding array<double>"
    table = spark.createDataFrame(memory, kind)
    asked = table.where("task_id < 't20'").unionByName(spark.createDataFrame([("new", "causal", 0.0, [1.0, 1.0, 0.0] if embedded else None), ("other", "unknown", None, None)], kind)).drop("best")
    found = {}
    for r in retrieval.recall(asked, table, 4, block).collect():
        found.setdefault(r.task_id, []).append((r.place, r.remembered, round(r.score, 6)))

    def cosine(a, b):
        if a is None or b is None:
            return 0.0
        norm = (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
        return sum(x * y for x, y in zip(a, b, strict=True)) / norm if norm > 1e-9 else 0.0

    rows = asked.collect()
    assert len(found) == len(rows) == 22
    for t in rows:
        scored = [(round((0.5 if k == t.intent_type else 0.0) + (b or 0.0) + 0.3 * cosine(t.embedding, e), 6), name) for name, k, b, e in memory if name != t.task_id]
        want = [s for s, _ in sorted(scored, key=lambda x: (-x[0], x[1]))[:4]]
        assert [s for _, _, s in sorted(found[t.task_id])] == pytest.approx(want)
        assert all((pytest.approx(s), name) in scored for _, name, s in found[t.task_id])


def test_recall_joins_by_kind(spark):
    table = spark.createDataFrame([("a", "causal", 0.5, None)], "task_id string, intent_type string, best double, embedding array<double>")
    plan = retrieval.recall(table.drop("best"), table)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
