"""Matching, nested answers, grades and retrieval on cases worked out by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from scorewright.functions import matching, text
from scorewright.operators import retrieval


def each(spark, kind, cases, column):
    """The column's value for each case, in order."""
    names = [c.split()[0] for c in kind.split(", ")]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], f"i int, {kind}").orderBy("i")
    return [r.got for r in df.select(column(*map(F.col, names)).alias("got")).collect()]


@pytest.mark.parametrize(("function", "cases"), [
    (matching.looks_numeric, [("4.5", True), (" -3 ", True), ("4.", False), ("$4", False), ("", False), (None, False)]),
    (matching.without_groups, [("author:X/forum:Y", "X Y"), (" Theme:Tea/green ", "Tea green"), ("a//b", "a b"), (None, "")]),
])
def test_one_text(spark, function, cases):
    assert each(spark, "a string", [c[:1] for c in cases], function) == [c[1] for c in cases]


@pytest.mark.parametrize(("function", "cases"), [
    (matching.number_in, [("$4.3", "it is 4.3!", True), ("4.3", "140.35", False), ("4.3", "4.30", False), ("1200", "$1,200 only", True), ("12", "12.5", True), ("5", "v1.5", False), ("no", "1", False), (None, "1", False), ("1", None, False)]),
    (matching.number_hit, [("3/2/22", "on 3/2/22.", True), ("$572.8", "572.8", True), ("1234", "1,234", True), ("none", "1", False)]),
    (matching.fuzzy_hit, [("Blue  Tea", "the blue tea", True), ("x", None, False), ("", "a", True)]),
    (matching.subject_in, [("Forum:News", "the news", True), ("a very long name of a thing that goes on", "a very long name of other things", True), ("short", "other", False), ("", "x", False)]),
    (matching.text_on_page, [("ABC", "xx abc", True), ("a" * 50, "a" * 40, True), ("", "x", False), (None, "x", False)]),
])
def test_two_texts(spark, function, cases):
    assert each(spark, "a string, b string", [c[:2] for c in cases], function) == [c[2] for c in cases]


def test_value_on_page(spark):
    cases = [(4.5, "costs 4.50", True), (4.5, "about 4.45 or so", True), (4.5, "4.2", False), (1200.0, "1,190 people", True), (7.0, "x7y", True), (0.0, "5", False), (0.0, "0.0", True), (3.0, None, False), (None, "3", False)]
    assert each(spark, "a double, b string", [c[:2] for c in cases], matching.value_on_page) == [c[2] for c in cases]


def test_triples(spark):
    cases = [("forum:News", "12", "News has 12 posts", True), ("forum:News", "12", "News has 120 posts", False), ("", "Red", "a red one", True), (None, "blue", "a red one", False), ("Missing", "red", "a red one", False)]
    assert each(spark, "a string, b string, c string", [c[:3] for c in cases], matching.triple_mentioned) == [c[3] for c in cases]


def test_string_score(spark):
    cases = [(' "Paris" ', "paris", None, 1.0), ("Paris!", "paris", None, 0.0), ("In Paris today", None, ["paris", "'Today'"], 1.0), ("In Paris", None, ["paris", "rome"], 0.0), ("x", None, None, None), ("paris", "Paris", ["rome"], 0.0)]
    assert each(spark, "a string, b string, c array<string>", [c[:3] for c in cases], matching.string_score) == [c[3] for c in cases]


def test_factoid_score(spark):
    cases = [("A  b", ["a B"], None, None, 1.0), ("x y", None, ["x", "y"], None, 1.0), ("x", None, ["x", "y"], None, 0.5), ("x", None, ["x", "y", "z"], None, 0.0), ("it was 3/2/22", None, ["on 3/2/22"], None, 1.0), ("x", None, None, ["x", "y"], 0.25), ("x y", None, None, ["x", "y"], 1.0), ("x", None, None, None, 0.0), (None, ["x"], None, None, 0.0), ("x", ["z"], ["q"], ["x"], 0.0)]
    assert each(spark, "a string, b array<string>, c array<string>, d array<string>", [c[:4] for c in cases], matching.factoid_score) == [c[4] for c in cases]
    assert each(spark, "a string, b array<string>, c array<string>, d array<string>, e array<string>", [("x", ["x"], None, None, ["url_match"]), ("x", ["x"], None, None, ["url_match", "string_match"])], matching.factoid_score) == [0.0, 1.0]


def test_facts_hold(spark):
    cases = [("price", "$1,000", "1049", True), ("price", "1000", "1060", False), ("price", "free", "0", False), ("rating", "0", "0", True), ("score", "100", "101", True), ("score", "100", "103", False), ("product_url", "Blue-Pot", "http://s/blue-pot.html", True), ("product_url", "Blue-Pot", "http://s/", False), ("forum", "f/news", "/f/News", True), ("author", "ann", "Ann Lee", True), ("forum", "news", "sport", False), ("price", None, "3", None), ("price", "", "3", None), ("theme", "x", "x", None)]
    assert each(spark, "a string, b string, c string", [c[:3] for c in cases], matching.fact_holds) == [c[3] for c in cases]


def test_json(spark):
    cases = [('{"a": 1}', True), ('text\n```json\n{"a": [1]}\n```\nmore', True), ("[1]", False), ("{broken", False), ("", False), (None, False)]
    assert [x is not None for x in each(spark, "a string", [c[:1] for c in cases], matching.json_object)] == [c[1] for c in cases]
    doc = '{"items": [{"n": "x"}, {"n": "y"}], "deep": {"list": [5, 6]}}'
    assert each(spark, "a string", [(doc,)], lambda a: matching.at_path(a, "deep.list[1]")) == ["6"]
    assert each(spark, "a string", [(doc,), ("{}",)], lambda a: matching.expanded(a, "items[*].n")) == [["items[0].n", "items[1].n"], []]
    assert each(spark, "a string", [(doc,)], lambda a: matching.expanded(a, "items")) == [["items"]]


def test_items(spark):
    items = [("Blue Pot", 12.0, 4.0, "http://s/1"), ("Red Pot", None, 5.0, None)]
    df = spark.createDataFrame([(1, items, '{"note": "Made in 1999"}')], "i int, items array<struct<name: string, price: double, rating: double, url: string>>, report string")
    fits = lambda conditions, facts=(): df.select(matching.report_fits(F.col("items"), conditions, F.col("report"), list(facts)).alias("x")).first().x
    one = lambda **given: [lambda item: matching.item_fits(item, **given)]
    assert fits(one(name_contains=["blue", "POT"], price=(10, 12), least_rating=4.0, url_pattern="/1$")) and fits([], ["made in 1999"]) and not fits([], ["2000"])
    assert not fits(one(name_contains=["red"], price=(0, 99))) and not fits(one(name_pattern="^pot")) and not fits(one(url_pattern="/2$")) and fits(one(name_pattern="red.*pot", least_rating=5.0))
    assert not fits([*one(name_contains=["blue"]), *one(name_contains=["green"])])


def test_evidence(spark):
    md = "# Limitations\none two\n## Data\nthree\n# Methodology of it\nfour five six\nhttp://localhost:7770/a-b-c.html http://LOCALHOST:7770/A-B-C.html http://localhost:9999/f/x/12"
    e = each(spark, "a string", [(md,), ("",), ("plain words",)], text.evidence)
    assert (e[0].products, e[0].posts) == (1, 1) and e[0].meta_ratio == pytest.approx(8 / 17)
    assert e[0].score == pytest.approx(0.4 / 6 + 0.3 / 4 + 0.3 * 9 / 17) and e[1].meta_ratio == 0.0 and (e[2].products, e[2].meta_ratio) == (0, 0.0)


def test_retrieval(spark):
    assert each(spark, "a string", [("Bluetooth noise on a PC",), ("",), (None,)], retrieval.hinted_forums) == [["headphones", "technology", "gaming"], [], []]
    assert each(spark, "a string, b string", [("Big red pot", "a RED pot"), ("a b", "x"), ("red red", None)], retrieval.overlap) == [pytest.approx(2 / 3), 0.0, 0.0]
    assert each(spark, "a string", [(" Causal chain\ncomparison",), ("x\ncomparison",), ("Fact Check",), (None,)], retrieval.intent) == ["causal", "recommendation", "debunking", "recommendation"]
    posts = spark.createDataFrame([("u1", "headphones", "none", ""), ("u2", "news", "audio guide", ""), ("u2", "news", "audio", "x"), ("u3", "news", "none", "")], "url string, forum string, title string, summary string")
    asked = spark.createDataFrame([(1, "audio guide")], "query_id int, query string")
    assert [(r.url, r.score) for r in retrieval.search_posts(asked, posts).orderBy("place").collect()] == [("u2", 1.0), ("u1", 0.5)]
    memory = spark.createDataFrame([("a", "causal", 0.2, [1.0, 0.0]), ("b", "causal", 0.1, [0.0, 1.0]), ("c", "timeline", None, None)], "task_id string, intent_type string, best double, embedding array<double>")
    found = retrieval.recall(spark.createDataFrame([("a", "causal", [0.0, 2.0])], "task_id string, intent_type string, embedding array<double>"), memory)
    assert [(r.remembered, round(r.score, 6)) for r in found.orderBy("place").collect()] == [("b", 0.9), ("c", 0.0)]


def test_grade_of_a_composite_at_a_threshold(spark, tmp_path):
    """0.14 + 0.162 + 0.235 + 0.063 is 0.6, a D; as a sum of doubles it is a little less."""
    import duckdb

    from scorewright.plans.matching import run_grades
    from scorewright.registry import ORACLES

    duckdb.sql("SELECT * FROM (VALUES (31206, 2353, 'O'), (1, 2353, 'O')) v(o_orderkey, o_custkey, o_orderstatus)").write_parquet(str(tmp_path / "orders.parquet"))
    row = run_grades(spark, str(tmp_path)).first()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet'")
    assert (row.composite, row.grade) == (0.6, "D") == con.execute(f"SELECT composite, grade FROM ({ORACLES['run_grades']})").fetchone()
