"""Small functions of products, tasks and comments, and task adapters, case by case."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from scorewright.functions import catalog
from scorewright.operators import adapters


def each(spark, schema, rows, expression):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"_i int, {schema}")
    return [r.x for r in df.select("_i", expression(*(F.col(c) for c in df.columns[1:])).alias("x")).orderBy("_i").collect()]


def test_relevance(spark):
    cases = [("Noise Cancelling Headphones", ["noise cancelling headphones"], True), ("a headphone stand", ["best headphones"], False), ("Big HEADPHONES, black", ["best headphones"], True), ("oak desk", ["best desk"], False), ("standing oak desk", ["Standing Desk oak"], True), ("desk", ["standing desk oak"], False), ("personal finance", ["personal finance book"], True), ("personal budget book", ["personal finance book"], False), ("book", ["book"], False), ("x", [], False), (None, ["headphones"], False), ("x", None, False)]
    assert each(spark, "t string, k array<string>", [c[:2] for c in cases], catalog.relevant) == [c[2] for c in cases]


def test_small_functions(spark):
    assert each(spark, "a string, t string", [("/x", "Over-Ear set"), ("/ear-stud", "Speaker ear stud"), (None, "lamp"), ("/x", "Phone  Case with speaker"), ("/ampere", "dynamo")], catalog.audio) == ["audio_positive", "negative_filter (ear stud)", "not_audio_keyword", "negative_filter (Phone  Case)", "not_audio_keyword"]
    assert each(spark, "t string", [("Sony WH-1000",), ("sony",), ("AB",), ("A1b-c",), (" Sony",), ("X" * 25,), (None,)], catalog.brand) == ["Sony", None, None, "A1b", None, None, None]
    assert each(spark, "t string", [("http://s/a-b-9.html",), ("http://s/a.html?x=1",), ("http://s/A.html",), (None,)], catalog.product_id) == ["a-b-9", None, None, None]
    assert each(spark, "t string", [("about $ 500 total, or $90",), ("$30 item, $500",), ("$5",), ("$12345",), (None,)], catalog.budget) == [500.0, None, None, 1234.0, None]
    assert each(spark, "t string", [("task_1",), ("",)], catalog.seed) == [int(__import__("hashlib").sha256(t.encode()).hexdigest()[:8], 16) for t in ("task_1", "")]
    assert each(spark, "c array<string>", [(["BUY now", "to the moon", "sell"],), (["buy", "sell"],), (["lol ape"],), (["nothing", None],), ([],), (None,)], catalog.mood) == ["bullish", "bullish", "mocking", "no clear sentiment", "no clear sentiment", "no clear sentiment"]
    assert each(spark, "t string", [("a\tb\r\n\n \tc\t\n",), ("",), (None,)], lambda t: catalog.rows_of(t, "\t")) == [[["a", "b"], ["c"]], [], []]
    assert each(spark, "t string", [("1|2\\E|3",)], lambda t: catalog.rows_of(t, "|")) == [[["1", "2\\E", "3"]]]


TASKS = [
    ({"task_id": 7, "start_url": "__SHOPPING__/a", "intent": "i", "require_login": True, "require_reset": 1, "eval": {"eval_types": ["program_html", "url_match"], "reference_answers": {"fuzzy_match": ["a", "b", "c"], "must_include": ["m"]}}}, ("wa_shop_0007", ["shopping"], "http://localhost:7770/a", True, True, 7, ["program_html", "url_match"], ["a", "b", "c"], [], ["m"])),
    ({"task_id": 12345, "sites": ["shopping", "map"], "eval": {"reference_answers": "text"}}, ("wa_shop_12345", ["shopping", "map"], "", False, False, 2, [], [], [], [])),
    ({"task_id": 8, "sites": ["shopping"], "require_login": False, "eval": {"eval_types": ["string_match"], "reference_answers": {"exact_match": ["x"], "fuzzy_match": ["a", "b"]}}}, ("wa_shop_0008", ["shopping"], "", False, False, 2, ["string_match"], ["a", "b"], ["x"], [])),
    ({"intent": "none"}, None), ([], None), ("broken", None),
]


def test_adapted(spark):
    rows = spark.createDataFrame([(t if isinstance(t, str) else json.dumps(t),) for t, _ in TASKS], "j string").select(F.try_parse_json("j").alias("value"))
    found = {r.task_id: r for r in adapters.adapted(rows).collect()}
    want = {w[0]: w for _, w in TASKS if w}
    names = ("task_id", "sites", "start_url", "require_login", "require_reset", "difficulty", "eval_types", "fuzzy_match", "exact_match", "must_include")
    assert {k: tuple(r[n] for n in names) for k, r in found.items()} == want
    assert [r.source_task_id for r in adapters.adapted(adapters.only_of(rows, "shopping")).collect()] == [8]
    counts = {(r.what, r.value): r.n for r in adapters.asked_for(adapters.adapted(rows)).collect()}
    assert counts == {("difficulty", "7"): 1, ("difficulty", "2"): 2, ("eval_type", "program_html"): 1, ("eval_type", "url_match"): 1, ("eval_type", "string_match"): 1}


@pytest.mark.parametrize(("text", "want"), [("__SHOPPING__/x __REDDIT__", "http://localhost:7770/x http://localhost:9999"), ("__OTHER__", "__OTHER__"), (None, None)])
def test_resolved(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(adapters.resolved(F.col("t"))).first()[0] == want
