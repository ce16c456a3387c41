"""Entailment, look-ups, isolated verifiers, filters with a log and memory: cases by hand and brute force."""

from __future__ import annotations

import hashlib
import random

import pandas as pd
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from scorewright.operators import evidence, memory
from scorewright.streaming import split


def test_chunks_cover_whole_pages(spark):
    rng = random.Random(1)
    bodies = ["".join(rng.choice("abcé😀 ") for _ in range(n)) for n in (0, 1, 9, 10, 11, 17, 18, 25, 100)] + [None]
    pages = spark.createDataFrame([(f"u{i}", b) for i, b in enumerate(bodies)] + [("u4", "zz")], "url string, body string")
    found = {}
    for r in evidence.chunked(pages, 10, 3).orderBy("place").collect():
        found.setdefault(r.url, []).append(r.chunk)
        assert r.chunk_hash == hashlib.md5(r.chunk.encode()).hexdigest()
    for i, body in enumerate(bodies):
        want = [body[s : s + 10] for s in range(0, max(len(body) - 3 - 1, 0) + 1, 7)] if body else None
        assert found.get(f"u{i}") == want, i
        if body:
            assert all(body[k : k + 4] in "\0".join(want) for k in range(len(body) - 3))


def test_entailment_by_brute_force(spark):
    rng = random.Random(2)
    pages = {f"u{i}": "".join(rng.choice("ab") for _ in range(rng.randrange(0, 40))) for i in range(6)}
    claims = [(d, "".join(rng.choice("ab") for _ in range(2)), f"u{rng.randrange(8)}") for d in range(12) for _ in range(5)]
    chunks = evidence.chunked(spark.createDataFrame(list(pages.items()), "url string, body string"), 8, 2)
    table = spark.createDataFrame(claims, "id int, claim string, url string")
    asked = evidence.to_judge(table, chunks)
    text = chunks.select("chunk_hash", "chunk").distinct()
    known = table.select(evidence.digest(F.col("claim")).alias("claim_hash"), "claim").distinct()
    verdicts = asked.join(text, "chunk_hash").join(known, "claim_hash").where("chunk_hash < 'c'").select("claim_hash", "chunk_hash", F.contains("chunk", F.col("claim")).alias("supported"))
    found = {r.id: (r.total_claims, r.supported_claims, r.no_page, r.unjudged, r.precision) for r in evidence.entailment(table, chunks, verdicts, "id").collect()}
    cut = {u: [b[s : s + 8] for s in range(0, max(len(b) - 2 - 1, 0) + 1, 6)] if b else [] for u, b in pages.items()}
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    for d in range(12):
        mine = [(c, cut.get(u, [])) for i, c, u in claims if i == d]
        held = [any(c in x and md5(x) < "c" for x in xs) for c, xs in mine]
        open_ = [not h and any(md5(x) >= "c" for x in xs) for h, (_, xs) in zip(held, mine, strict=True)]
        assert found[d] == (5, sum(held), sum(not xs for _, xs in mine), sum(open_), sum(held) / 5)
    left = evidence.to_judge(table, chunks, verdicts.select("claim_hash", "chunk_hash"))
    assert left.count() == asked.count() - verdicts.count()


def test_pages_are_not_shuffled_with_claims(spark):
    pages = spark.range(3).selectExpr("CAST(id AS STRING) AS url", "repeat('x', 100) AS chunk", "md5(CAST(id AS STRING)) AS chunk_hash")
    claims = spark.range(5).selectExpr("id", "CAST(id AS STRING) AS claim", "CAST(id % 3 AS STRING) AS url")
    verdicts = spark.createDataFrame([], "claim_hash string, chunk_hash string, supported boolean")
    plan = evidence.entailment(claims, pages, verdicts, "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "repeat" not in plan and "NestedLoop" not in evidence.entailment(claims, pages, verdicts, "id")._jdf.queryExecution().executedPlan().toString()


def test_prefixes_by_brute_force(spark):
    rng = random.Random(3)
    draw = lambda n: "".join(rng.choice("ab%_é") for _ in range(n))
    names = [(i, draw(rng.randrange(0, 90)) if i % 7 else "aaaa" * 16 + draw(3), i * 10) for i in range(120)] + [(200, None, 1)]
    subjects = [(i, draw(rng.randrange(0, 4)) if i % 3 else (rng.choice(names[:-1])[1] + ("more" if i % 2 else ""))) for i in range(60)] + [(99, None), (98, "a" * 70)]
    found = evidence.by_prefix(spark.createDataFrame(subjects, "s int, subject string"), spark.createDataFrame(names, "id int, name string, worth int"), ["worth"])
    got = {r.s: (r.found_id, r.worth) for r in found.collect()}
    for s, subject in subjects:
        hits = [(i, w) for i, n, w in names if subject is not None and n is not None and n.startswith(subject[:60])]
        assert got[s] == (min(hits) if hits else (None, None)), subject
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and plan.count("BroadcastNestedLoopJoin") <= 2  # the one row of lengths alone


def test_a_check_that_breaks_down_leaves_the_others(spark):
    def fragile(rows: pd.DataFrame) -> pd.Series:
        if (rows["x"] % 7 == 0).any():
            raise ZeroDivisionError("seven")
        return rows["x"] / 100

    rows = spark.range(200).selectExpr("id", "id AS x", "array('fragile', 'steady', CASE WHEN id % 50 = 0 THEN 'unknown' END) AS kinds").unionByName(spark.range(200, 203).selectExpr("id", "id AS x", "CAST(array() AS array<string>) AS kinds"))
    checks = {"fragile": fragile, "steady": lambda rows: rows["x"] * 0 + 0.5}
    results = evidence.dispatched(rows.withColumn("kinds", F.array_compact("kinds")), checks, ["x"])
    found = {(r.id, r.kind): (r.score, r.passed, r.error) for r in results.collect()}
    for i in range(200):
        assert found[i, "fragile"] == ((0.5, True, "ZeroDivisionError: seven") if i % 7 == 0 else (min(i / 100, 1.0), i >= 50, None))
        assert found[i, "steady"] == (0.5, True, None)
    assert found[50, "unknown"] == (0.0, False, "unsupported kind: unknown") and len(found) == 404
    whole = {r.id: tuple(r)[1:] for r in evidence.combined(rows, results).collect()}
    assert whole[51] == (2, 0.255, True, 0) and whole[50] == (3, 0.0, False, 1) and whole[14] == (2, 0.25, True, 1) and whole[200] == (0, 0.0, False, 0) and len(whole) == 203


def test_both_sinks_survive_a_crash(spark, tmp_path):
    """The stream dies between a batch's read and its commit, and again; afterwards each hit is in one sink, once."""
    hits = [(i, f"http://{'localhost:7770' if i % 3 else 'evil.org'}/{i}" if i % 10 else None) for i in range(90)]
    for part in range(3):
        spark.createDataFrame(hits[part * 30 : part * 30 + 30], "id long, url string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema("id long, url string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    (tmp_path / "armed").touch()
    armed = str(tmp_path / "armed")

    @F.udf("string")
    def trap(i):
        import os

        if i == 45 and os.path.exists(armed):
            raise RuntimeError("killed")

    reason = F.coalesce(split.refusal(["localhost:7770"]), trap("id"))
    for _ in range(2):
        with pytest.raises(StreamingQueryException):
            split.split_stream(source(), reason, str(tmp_path / "out"), str(tmp_path / "check"))
    (tmp_path / "armed").unlink()
    accepted, rejected = split.split_stream(source(), reason, str(tmp_path / "out"), str(tmp_path / "check"))
    want = {i for i, u in hits if u and "7770" in u}
    assert sorted(r.id for r in accepted.collect()) == sorted(want)
    assert sorted((r.id, r.reason) for r in rejected.collect()) == sorted((i, "no_url" if u is None else "non_sandbox_url_blocked") for i, u in hits if i not in want)
    again = split.split_stream(source(), reason, str(tmp_path / "out"), str(tmp_path / "check"))
    assert again[0].count() + again[1].count() == 90


def test_memory_by_hand(spark):
    md = "# One\ntext\n#### Four\n##   Two  \n[a](http://localhost:7770/x) [a](http://localhost:7770/x) [b](http://localhost:9999/f/1) [c](https://localhost:7770/y)\n### Three"
    rows = [
        ("a", "t1", "A causal question\nmore", 0.5, 0.9, 4, {"s": 3, "r": 1}, None), ("b", "t1", "A causal question", 0.7, 0.9, None, None, md), ("c", "t1", "A causal question", 0.7, 0.2, 6, {"s": 1}, "# Other"),
        ("d", "t1", "x", 0.039, 0.9, 9, {}, md), ("e", "t1", "x", 0.9, 0.19, 9, {}, md), ("f", "t1", "x", None, 0.9, 9, {}, md), ("a", "t2", None, 0.04, 0.2, 1, {"r": 5}, ""),
    ]
    runs = spark.createDataFrame(rows, "agent string, task string, intent string, composite double, reach double, citations int, per_domain map<string,int>, md string").selectExpr("*", "0.5D AS recall", "CAST(NULL AS DOUBLE) AS checklist")
    tasks = {r.task: r for r in memory.of_tasks(runs).collect()}
    assert [r.agent for r in tasks["t1"].best_runs] == ["b", "c", "a"] and tasks["t1"].intent_type == "causal" and tasks["t1"].section_skeleton == ["One", "Two", "Three"]
    assert tuple(tasks["t1"].cited_url_patterns) == ([], [], []) and tasks["t2"].section_skeleton == [] and tasks["t2"].intent_type == "recommendation"
    kinds = {r.intent_type: r for r in memory.of_intents(runs).collect()}
    c = kinds["causal"]
    assert (c.n_tasks, c.n_runs, c.avg_citation_count, c.section_count_avg, c.citation_distribution, c.exemplar_tasks, c.usual_sections) == (1, 3, 3.3, 2.0, {"s": 0.8, "r": 0.2}, ["t1"], ["One", "Other", "Two", "Three"])
    assert tuple(memory.of_all(memory.of_tasks(runs)).first()) == (2, 4, 4, 70)
    assert tuple(memory.of_all(memory.of_tasks(runs.limit(0))).first()) == (0, 0, 60, 120)
    links = spark.createDataFrame([(md,)], "md string").select(memory.url_patterns(F.col("md")).alias("u")).first().u
    assert tuple(links) == (["http://localhost:7770/x"], ["http://localhost:9999/f/1"], [])
