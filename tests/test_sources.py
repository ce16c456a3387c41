"""Readers and writers on files of the shapes that scoring writes."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F
from scorewright.operators import battles
from scorewright.sources import readers


def put(folder, name, what):
    (folder / name).write_text(what if isinstance(what, str) else json.dumps(what), encoding="utf-8")


@pytest.fixture
def scores(tmp_path):
    full = {"task": "x", "answer_chars": 900, "url_coverage": {"score": 0.5}, "url_reachability": {"score": 1.0, "details": {"cited_total": 4, "infra_failure": False}}, "checklist": {"pass_rate": 0.25}, "markdown_spec": {"words_ok": True, "citations_ok": True}, "answer_path": "data/storm.answer.md"}
    put(tmp_path, "storm__t_1_matrix.score.json", full)
    put(tmp_path, "storm__t_2_matrix.score.json", full | {"answer_chars": 0})
    put(tmp_path, "ldr__t_1_matrix.score.json", "{not json")
    put(tmp_path, "ldr__t_2_matrix.score.json", full | {"checklist": {"verdicts": [["a", "PASS"], ["b", "UNCLEAR"], ["c", "FAIL"], ["d", "pass"]]}, "answer_path": "bad.answer.md"})
    put(tmp_path, "ldr__t_1_v4.score.json", full)
    put(tmp_path, "notes.json", {})
    put(tmp_path, "bad.answer.md", "(LDR produced no report after 3s, exit=1)\nlong tail")
    return str(tmp_path)


def test_scores(spark, scores):
    kept, counts = readers.load_scores(spark, f"{scores}/*.json")
    assert {(r.agent, r.task) for r in kept.collect()} == {("storm", "t_1"), ("ldr", "t_2")}
    assert {r.agent: (r.total, r.load_error, r.degenerate, r.kept) for r in counts.collect()} == {"storm": (2, 0, 1, 1), "ldr": (2, 1, 0, 1)}
    r = kept.where("agent = 'storm'").first()
    assert (r.url, r.chk, r.cited, r.qm) == (0.5, 0.25, 4, 0.0) and r.spc == pytest.approx(2 / 3) and r.composite == pytest.approx(0.4 * 0.5 + 0.4 * 0.25 + 0.2 * 2 / 3)
    assert kept.where("agent = 'ldr'").first().chk == pytest.approx(2.5 / 4)
    answers = readers.reports(spark, f"{scores}/*.md")
    kept, counts = readers.load_scores(spark, f"{scores}/*.json", answers=answers)
    assert {r.agent: (r.degenerate, r.kept) for r in counts.collect()} == {"storm": (1, 1), "ldr": (1, 0)}
    assert readers.load_scores(spark, f"{scores}/*.json", drop_degenerate=False)[0].count() == 3


def test_runs_and_battles(spark, tmp_path):
    put(tmp_path, "final_a_t.json", {"agent": "a", "task_id": "t", "composite": 0.1})
    put(tmp_path, "final_a_t.ed.json", {"agent": "a", "task_id": "t", "composite": 0.9, "pillars": {"x": {"score": 0.5}}})
    put(tmp_path, "final_b_t.json", {"agent": "b", "task_id": "t", "composite": 0.2})
    put(tmp_path, "final_c.json", "oops")
    assert {(r.agent, r.composite) for r in readers.runs(spark, f"{tmp_path}/final_*").collect()} == {("a", 0.9), ("b", 0.2)}
    put(tmp_path, "pairwise_glm.json", {"battles": [{"a1": "x", "a2": "y", "agent_winner": "y"}, {"agent_a": "x", "agent_b": "y", "winner": "tie", "judge_model": "own"}]})
    put(tmp_path, "pairwise_q.json", {"judge_model": "file", "battles": [{"a": "x", "b": "y", "score_a": 0.75}]})
    rows = readers.battles(spark, f"{tmp_path}/pairwise_*")
    assert sorted((r.judge_model, r.agent_winner) for r in rows.collect()) == [("file", None), ("glm", "y"), ("own", None)] or {r.judge_model for r in rows.collect()} == {"file", "glm", "own"}
    assert sorted((r.a, r.b, r.score_a) for r in battles.normalised(rows).collect()) == [("x", "y", 0.0), ("x", "y", 0.5), ("x", "y", 0.75)]


def test_preferences(spark, tmp_path):
    path = str(tmp_path / "prefs")
    rows = [("t", "a", "b", w, ["depth"], "me", "now") for w in ("a", "tie", "neither")] + [(None, "a", "b", "a", None, None, None)]
    readers.append_preferences(spark.createDataFrame(rows, readers.PREFERENCE), path)
    readers.append_preferences(spark.createDataFrame(rows[:1], readers.PREFERENCE), path)
    put(tmp_path / "prefs", "more.json", '{"task_id": "t", "agent_a": "a", "agent_b": "b", "winner": "b"}\nnot json\n{"winner": "a"}\n')
    assert sorted(r.winner for r in readers.preferences(spark, path).collect()) == ["a", "a", "b", "tie"]


def test_golden(spark, tmp_path):
    triple = lambda s: {"subject": s, "predicate": "is", "object": "o"}
    put(tmp_path, "t1.json", {"must_cite_urls": [{"url": "http://a/", "weight": 2.0}], "expected_pool_urls": [], "triples": [triple("all"), triple("more")]})
    put(tmp_path, "t1.filtered.json", {"triples": [triple("best")]})
    put(tmp_path, "t2.json", {"triples": [triple("only")]})
    put(tmp_path, "t2.filtered.json", {"triples": []})
    assert sorted((r.task, r.subject) for r in readers.golden_triples(spark, str(tmp_path)).collect()) == [("t1", "best"), ("t2", "only")]
    must, pool, triples = readers.golden_bundle(spark, str(tmp_path))
    assert [(r.task, r.url, r.weight) for r in must.collect()] == [("t1", "http://a/", 2.0)] and pool.count() == 0 and triples.count() == 4


def test_dimension_scores(spark, tmp_path):
    put(tmp_path, "s.json", {"scores": {"a": {"depth": 0.3}}})
    put(tmp_path, "e.json", {"pillar_elo": {"url": {"a": 900.0, "b": 1100.0, "c": 1000.0}, "flat": {"a": 5.0, "b": 5.0}}})
    found = {(r.agent, r.dim): r.score for r in readers.dimension_scores(spark, str(tmp_path)).collect()}
    assert found == {("a", "depth"): 0.3, ("a", "url"): 0.0, ("b", "url"): 1.0, ("c", "url"): 0.5, ("a", "flat"): 0.5, ("b", "flat"): 0.5}


def test_worksheet(spark, tmp_path):
    put(tmp_path, "sheet.md", "# Sheet\n\n| # | domain | url | snippet | reach | support | notes |\n|---|---|---|---|---|---|---|\n| 1 | shop | http://a | s | Y | n | x |\n| 2 | shop | http://b | s | yes | ✓ | |\n| 3 | wiki | http://c | s | | | |\n| 4 | wiki | http://c | s | no | no | |\n")
    rows = readers.worksheet(spark, f"{tmp_path}/sheet.md")
    assert [(r.number, r.domain, r.reach) for r in rows.orderBy("number").collect()] == [(1, "shop", "Y"), (2, "shop", "yes"), (3, "wiki", ""), (4, "wiki", "no")]
    assert {r.domain: (r.checked, r.reach_rate, r.support_rate) for r in readers.worksheet_rates(rows).collect()} == {"shop": (2, 1.0, 0.5), "wiki": (1, 0.0, 0.0)}


def test_tasks(spark, tmp_path):
    tasks = readers.Tasks(spark, str(tmp_path / "tasks"))
    kind = "task_id string, difficulty string, iaa double, domain string"
    tasks.save(spark.createDataFrame([("t1", "easy", 0.5, "shop"), ("t2", "hard", 0.7, "shop"), ("t3", "hard", None, "wiki")], kind))
    tasks.save(spark.createDataFrame([("t2", "easy", 0.9, "shop")], kind))
    assert [(r.task_id, r.difficulty) for r in tasks.listed().collect()] == [("t1", "easy"), ("t2", "easy"), ("t3", "hard")]
    assert tasks.load("shop", "t2").first().iaa == 0.9 and tasks.load("wiki", "t2").count() == 0
    plan = tasks.load("shop", "t2")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(domain" in plan
    assert {(r.domain, r.difficulty): (r.tasks, r.mean_iaa) for r in tasks.statistics().collect()}[(None, None)] == (3, 0.7)
    assert tasks.delete("shop", "t1") and not tasks.delete("shop", "t1") and tasks.delete("wiki", "t3")
    assert [r.task_id for r in tasks.listed().collect()] == ["t2"] and tasks.listed("shop", "hard").count() == 0


def test_boards(spark, tmp_path):
    board = spark.createDataFrame([("b", 2, 0.5), ("a", 1, None)], "agent string, rank int, score double")
    assert readers.markdown_board(board, "rank", "rank", "agent", "score") == ["| rank | agent | score |", "|---|---|---|", "| 1 | a | - |", "| 2 | b | 0.5 |"]
    readers.write_board(board, str(tmp_path / "board"))
    assert spark.read.option("header", True).csv(str(tmp_path / "board")).select(F.sum("rank")).first()[0] == 3
