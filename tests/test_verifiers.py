"""Verifiers on reports worked out by hand: all forms of citations, none at all, null and empty texts."""

from __future__ import annotations

from itertools import combinations

import pytest
from pyspark.sql import functions as F
from scorewright.functions import numeric, text, url
from scorewright.operators import citations, filters, verifiers

SHOP, FORUM, WIKI = "http://localhost:7770", "http://localhost:9999", "http://localhost:8090"
FORMS = f"""See [a]({SHOP}/x/?b=2&a=1#f). Bare {FORUM}/f/audio/1, and [1] [2][^n] [9]
Source: {WIKI}/wiki/Foo.
- {SHOP}/y/

[1] A title. {SHOP}/z
[2]: [t]({FORUM}/f/Video/2)
[^n]: https://elsewhere.org/p
"""
REPORTS = [(1, 0, FORMS), (2, 0, "No link at all. " * 10), (3, 1, None), (4, 1, ""), (5, 0, f"[x]({SHOP}/a) and [y]({SHOP}/a/) [z]({FORUM}/f/audio/1)")]


@pytest.fixture(scope="module")
def reports(spark):
    return spark.createDataFrame(REPORTS, "doc_id long, task int, md string")


def rows(df, *columns):
    return {r.doc_id: tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()}


@pytest.mark.parametrize(("given", "wanted"), [
    ("HTTP://User@LocalHost:7770/A/b/?z=1&a=%7Eb+c#top", "http://localhost:7770/A/b?a=~b+c&z=1"), ("https://x.org:443", "https://x.org/"), ("http://x.org:80/", "http://x.org/"), ("https://x.org:80/a", "https://x.org/a"), ("http://x.org:8080//", "http://x.org:8080"),
    (f"{WIKI}/kiwix/content/book/A/Some_Page", f"{WIKI}/content/wikipedia_en_all_nopic/A/some_page"), (f"{WIKI}/wiki/Some", f"{WIKI}/content/wikipedia_en_all_nopic/A/some"), ("http://other.org/wiki/Some", "http://other.org/wiki/Some"),
    ("http://x.org/a;v=1?q&r=*", "http://x.org/a?q=&r=%2A"), ("http://x.org/a).", "http://x.org/a"), ("no url", ""), ("", ""), (None, None), ("http://x.org/a?b=1&b=0&&", "http://x.org/a?b=0&b=1"),
])
def test_canonical(spark, given, wanted):
    assert spark.createDataFrame([(given,)], "u string").select(url.canonical(F.col("u")).alias("c")).first().c == wanted


def test_host_and_domain(spark):
    df = spark.createDataFrame([(f"{SHOP}/a",), ("http://localhost:77703/",), ("http://www.shop.example.co/",), ("http://a.b/?u=localhost:7770",), ("x",)], "u string")
    found = df.select(url.host_in(F.col("u"), ["localhost:7770", "b"]).alias("a"), url.host_in(F.col("u"), ["localhost"]).alias("b"), url.domain(F.col("u")).alias("d")).collect()
    assert [(r.a, r.b, r.d) for r in found] == [(True, True, "localhost:7770"), (False, True, "localhost:77703"), (False, False, "example.co"), (False, False, "a.b"), (False, False, "")]


def test_citations_in_all_forms(reports):
    found = [(r.style, r.raw_url, FORMS[r["at"] : r["at"] + 8]) for r in citations.citations(reports).where("doc_id = 1").collect()]
    assert found == [
        ("markdown", f"{SHOP}/x/?b=2&a=1#f", "[a](http"), ("bare", f"{FORUM}/f/audio/1", "http://l"), ("numbered", f"{SHOP}/z", "[1] [2]["), ("numbered", f"{FORUM}/f/Video/2", "[2][^n] "), ("footnote", "https://elsewhere.org/p", "[^n] [9]"),
        ("source", f"{WIKI}/wiki/Foo", "http://l"), ("bullet", f"{SHOP}/y/", "http://l"), ("numbered", f"{SHOP}/z", "[1] A ti"), ("bare", f"{SHOP}/z", "http://l"), ("numbered", f"{FORUM}/f/Video/2", "[2]: [t]"), ("markdown", f"{FORUM}/f/Video/2", "[t](http"),
        ("footnote", "https://elsewhere.org/p", "[^n]: ht"), ("bare", "https://elsewhere.org/p", "https://"),
    ]
    assert citations.citations(reports).where("doc_id in (2, 3, 4)").count() == 0
    assert {r.raw_url for r in citations.citations(reports, ["localhost:7770"]).where("doc_id = 1").collect()} == {f"{SHOP}/x/?b=2&a=1#f", f"{SHOP}/z", f"{SHOP}/y/"}


def test_claims_are_windows(spark):
    md = "a" * 300 + f" [label]({SHOP}/a) `code` end\n\n" + "b" * 300
    claim = citations.citations(spark.createDataFrame([(1, md)], "doc_id long, md string")).first().claim
    assert claim.startswith("a" * 199 + " label end " + "b") and "code" not in claim and "http" not in claim


def test_every_report_has_a_row(spark, reports):
    pages = spark.createDataFrame([(f"{SHOP}/a", 200, "x y z words")], "url string, status int, body string")
    entities = spark.createDataFrame([(1, "audio")], "doc_id long, entity string")
    nothing = spark.createDataFrame([], "url string, claim_hash long, sentence_hash long, prob double, supported boolean, pair_hash long, verdict string, quote string, task int, topic string, prior_value string, sandbox_value string, value string, value_type string, doc_id long, weight double, code int")
    made = [
        verifiers.degenerate(reports), verifiers.markdown_contract(reports), verifiers.url_coverage(reports, nothing, nothing), verifiers.url_reachability(reports, nothing), verifiers.quote_match(reports, pages), verifiers.claim_support(reports, nothing, nothing),
        verifiers.citation_alignment(reports, nothing), verifiers.source_diversity(reports), verifiers.analysis_depth(reports), verifiers.presentation(reports), verifiers.perspective(reports, entities), verifiers.refusals(reports), verifiers.compliance(reports),
        verifiers.contamination(reports, nothing), verifiers.factual_exactness(nothing, pages, reports), verifiers.internal_consistency(reports, nothing), verifiers.citation_check(reports, pages),
    ]
    for df in made:
        assert sorted(r.doc_id for r in df.collect()) == [1, 2, 3, 4, 5], df.columns
        assert df.select("doc_id").join(reports.limit(0), "doc_id").count() == 0


def test_degenerate(spark):
    md = [("word " * 60, "zero_citations"), ("word " * 60 + f"{SHOP}/a", ""), ("word " * 49 + f"[one]({SHOP}/a)", ""), ("word " * 48 + f"[one]({SHOP}/a)", "word_count_too_low:49"), (" \n", "empty_answer"), (None, "empty_answer"), ("(Timeout after 3 s)", "answer_starts_with:(timeout"), ("(empty storm output)", "answer_starts_with:(empty")]
    df = spark.createDataFrame([(i, m) for i, (m, _) in enumerate(md)], "doc_id long, md string")
    assert rows(verifiers.degenerate(df), "reason") == {i: r for i, (_, r) in enumerate(md)}
    assert rows(verifiers.degenerate(df, require_citations=False), "degenerate")[0] is False


def test_markdown_contract(spark):
    df = spark.createDataFrame([(1, f"one two three [l]({SHOP}/a)\n\nfour-five it's", 3), (2, "w " * 11, None), (3, None, 0)], "doc_id long, md string, pages int")
    found = {r.doc_id: r for r in verifiers.markdown_contract(df, 5, 10, 2, 1, 2, ("LOCALHOST:7770",), "pages").collect()}
    assert (found[1].words, found[1].paragraphs, found[1].citations) == (10, 2, 1) and found[1].passed and found[1].score == 1.0
    assert found[2].not_too_many == 0.5 and found[2].enough_pages == 1.0 and found[2].score == 0.5 and not found[2].passed
    assert found[3].enough_pages == 0.0 and found[3].score == 0.2


def test_url_coverage(spark, reports):
    must = spark.createDataFrame([(0, f"{SHOP}/a", 3.0), (0, f"{SHOP}/other", 1.0)], "task int, url string, weight double")
    pool = spark.createDataFrame([(0, f"{SHOP}/a"), (0, f"{FORUM}/f/audio/1"), (0, f"{WIKI}/q"), (0, f"{WIKI}/r")], "task int, url string")
    found = {r.doc_id: r for r in verifiers.url_coverage(reports, must, pool, {"shop": (["localhost:7770"], 2), "forum": (["localhost:9999"], 1)}, min_urls=2, min_balance=0.5).collect()}
    r = found[5]
    assert (r.cited, r.must_hit, r.must_recall, r.pool_hit, r.pool_share, r.cited_shop, r.cited_forum, r.domain_balance) == (2, 1, 0.75, 2, 0.5, 1, 1, 0.5)
    assert r.score == pytest.approx(0.55 * 0.75 + 0.15 * 0.5 + 0.3 * 0.5) and r.passed
    assert (found[2].score, found[2].passed, found[2].must_total) == (0.0, False, 2) and (found[3].must_total, found[3].score) == (0, 0.0)
    assert rows(verifiers.url_coverage(reports, must, pool), "domain_balance")[2] == 1.0


def test_url_reachability(spark, reports):
    status = spark.createDataFrame([(f"{SHOP}/a/", 200), (f"{FORUM}/f/audio/1", 500), (f"{SHOP}/z", 404), (f"{SHOP}/y", 429), (f"{FORUM}/f/Video/2", None)], "url string, code int")
    found = {r.doc_id: r for r in verifiers.url_reachability(reports, status).collect()}
    assert (found[5].cited, found[5].cited_inside, found[5].ok, found[5].server, found[5].score, found[5].passed, found[5].infra_warning) == (2, 2, 1, 1, 1.0, True, True)
    r = found[1]  # inside: x (none), audio (500), z (404), Video (none), Foo (none), y (429)
    assert (r.cited, r.cited_inside, r.ok, r.broken, r.server, r.none, r.score, r.passed, r.infra_failure) == (7, 6, 0, 1, 1, 3, 0.0, False, False)
    assert (found[2].score, found[2].passed) == (0.0, False)


def test_quote_match(spark):
    df = spark.createDataFrame([(1, f"Blue whales eat krill daily [w]({SHOP}/w) and [gone]({SHOP}/gone)"), (2, None)], "doc_id long, md string")
    pages = spark.createDataFrame([(f"{SHOP}/w", "whales and krill"), (f"{SHOP}/w", "zzz")], "url string, body string")
    assert rows(verifiers.quote_match(df, pages), "claims", "supported", "unreachable", "score", "passed") == {1: (2, 1, 1, 0.5, True), 2: (0, 0, 0, 0.0, False)}
    assert rows(verifiers.quote_match(df, pages, floor=0.5), "supported")[1] == 0


def test_source_diversity(spark):
    md = f"{SHOP}/1 {SHOP}/1 {FORUM}/f/Audio/1 {FORUM}/f/audio/2 {FORUM}/f/video/3 {WIKI}/A/x http://else.org/"
    found = verifiers.source_diversity(spark.createDataFrame([(1, md)], "doc_id long, md string"), least={"shopping": 4, "reddit": 3, "wiki": 1}).first()
    import math

    p = [2 / 6, 3 / 6, 1 / 6]
    entropy, top, balance, forums = -sum(x * math.log(x) for x in p) / math.log(3), (0.6 - 0.5) / 0.25, 0.5, 2 / 3
    assert (found.citations, found.inside, found.hosts, found.subforums) == (7, 6, 3, 2)
    assert (found.entropy, found.top_score, found.type_balance) == (round(entropy, 4), pytest.approx(top), balance)
    assert found.score == pytest.approx(0.35 * entropy + 0.25 * top + 0.25 * balance + 0.15 * forums, abs=1e-4)


def test_analysis_depth(spark):
    cross = f"However, sources differ: [a]({SHOP}/a) and [b]({FORUM}/b), and also {WIKI}/c is better than most."
    one = f"Three links of one domain [a]({SHOP}/a) [b]({SHOP}/b) [c]({SHOP}/c) are no chain."
    df = spark.createDataFrame([(1, "\n\n".join([cross] * 3 + [one, "short"])), (2, f"{one}\n \nIt is whereas said twice."), (3, "")], "doc_id long, md string")
    assert rows(verifiers.analysis_depth(df), "paragraphs", "cross_source", "contradictions", "chains", "density", "score") == {1: (4, 3, 3, 3, 0.75, 1.0), 2: (2, 0, 1, 0, 0.5, 0.25), 3: (0, 0, 0, 0, 0.0, 0.0)}
    judged = spark.createDataFrame([(1, 0.5)], "doc_id long, tier_b double")
    assert rows(verifiers.analysis_depth(df, judged), "score")[1] == pytest.approx(0.4 + 0.3)


def test_presentation(spark):
    full = "# T\n\nintro words\n\n" + "".join(f"## S{i}\n\nThe cat sat on the mat.\n\n### D{i}\n\n- item\n\n" for i in range(5))
    df = spark.createDataFrame([(1, full), (2, "word " * 201), (3, None), (4, "word " * 200 + "\n# H\n\nx")], "doc_id long, md string")
    found = {r.doc_id: r for r in verifiers.presentation(df).collect()}
    assert (found[1].levels, found[1].sections, found[1].listed, found[1].orphans, found[1].score) == (3, 6, True, 0, 1.0)
    assert (found[2].levels, found[2].sections, found[2].orphans) == (0, 1, 1) and found[4].orphans == 0
    assert (found[3].ease, found[3].sections, found[3].score) == (0.0, 0, pytest.approx(1 / 6, abs=1e-4))


def test_reading_ease(spark):
    def plain(body):
        import re

        pieces, words = [s for s in re.split(r"[.!?]+", body) if s.strip()], re.findall(r"[a-zA-Z]+", body)
        if not pieces or not words:
            return 0.0
        count = 0
        for w in words:
            w = w.lower()
            w = w[:-1] if len(w) > 2 and w[-1] == "e" else w
            count += max(1, len(re.findall("[aeiouy]+", w)))
        return 206.835 - 1.015 * len(words) / len(pieces) - 84.6 * count / len(words)

    bodies = ["The cat sat. It made a rhythm, be true!", "", "...", "e ee the The queue's 42 hmm", "Ünïcode naïve café. Être", "me be we free; tree? shhh!", "a", "no end"]
    found = [r.e for r in spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, b string").orderBy("i").select(text.reading_ease(F.col("b")).alias("e")).collect()]
    assert found == pytest.approx([plain(b) for b in bodies])


def test_refusals(spark):
    md = ["It does not exist; I was unable to find it.", "It does not exist, reportedly.", "Reportedly and allegedly unverified.", "A fine book.", "See http://x.org/The-Lost-Book/1. It does not exist. I am unable to say.", "Launched in 1999; does not exist and no evidence found", None, "It does not exist."]
    found = rows(verifiers.refusals(spark.createDataFrame(list(enumerate(md)), "doc_id long, md string"), ["The Lost Book"], [r"launched in \d+"]), "verdict", "score")
    assert found == {0: ("REFUSAL", 1.0), 1: ("REFUSAL", 1.0), 2: ("PARTIAL_HEDGE", 0.5), 3: ("AMBIGUOUS", 0.3), 4: ("HALLUCINATION_URL", 0.0), 5: ("HALLUCINATION_CLAIMS", 0.0), 6: ("AMBIGUOUS", 0.3), 7: ("AMBIGUOUS", 0.3)}


def test_perspective(spark):
    md = "Alpha is excellent and superb. " + "x" * 120 + " The beta has a flaw, but good; Beta-2 is long-lasting. " + "x" * 120 + " bad"
    df = spark.createDataFrame([(1, md), (2, "none")], "doc_id long, md string")
    entities = spark.createDataFrame([(1, "Alpha"), (1, "beta"), (1, "C++ (x)"), (1, " ")], "doc_id long, entity string")
    r = {x.doc_id: x for x in verifiers.perspective(df, entities).collect()}
    assert (r[1].entities, r[1].mentioned, r[1].balanced) == (3, 2, 1) and r[1].score == pytest.approx(1 / 3, abs=1e-4)
    # two windows of beta: each has flaw, but (negative), good, long-lasting (positive)
    assert (r[1].positive, r[1].negative) == (2 + 4, 4) and (r[2].entities, r[2].score) == (0, 1.0)
    judged = spark.createDataFrame([(1, "Alpha", True)], "doc_id long, entity string, specific boolean")
    assert rows(verifiers.perspective(df, entities, judged), "score")[1] == pytest.approx(1 / 3, abs=1e-4)


def test_heading_entities(spark):
    md = "### 1. Sony X\n### Introduction to it\n### Top 3: Bose Y\n### sony x\n### ab\n## No\n### (2) -Zed Z-\n"
    assert {r.entity for r in verifiers.heading_entities(spark.createDataFrame([(1, md)], "doc_id long, md string")).collect()} == {"Sony X", "Bose Y", "Zed Z"}


def test_compliance(reports):
    found = rows(verifiers.compliance(reports), "urls", "allowed", "score", "passed")
    assert found == {1: (7, 6, round(6 / 7, 6), False), 2: (0, 0, 1.0, True), 3: (0, 0, 1.0, True), 4: (0, 0, 1.0, True), 5: (2, 2, 1.0, True)}


def test_contamination(spark):
    df = spark.createDataFrame([(1, "Paris has  TWO million; " + "x" * 700 + " five million"), (2, "five million"), (3, None), (4, "Paris: two million or five million")], "doc_id long, md string")
    facts = spark.createDataFrame([("paris", "five million", "two million")], "topic string, prior_value string, sandbox_value string")
    found = rows(verifiers.contamination(df, facts), "sandbox", "prior", "both", "topic_not_referenced", "score")
    assert found == {1: (1, 0, 0, 0, 1.0), 2: (0, 1, 0, 0, 0.0), 3: (0, 0, 0, 1, 0.0), 4: (0, 0, 1, 0, 0.5)}


def test_contamination_in_blocks(spark):
    """As many facts as one likes: blocks of two give what all at once give."""
    names = ["Paris", "rome  x", "(oslo)", "Bern", None]
    df = spark.createDataFrame([(i, f"{names[i % 5] or ''} has {i % 4} million and {names[(i + 1) % 5] or ''} {i % 3}") for i in range(20)], "doc_id long, md string")
    facts = spark.createDataFrame([(n, f"{i} million", str(i)) for i, n in enumerate(names * 2)], "topic string, prior_value string, sandbox_value string")
    whole, parts = (sorted(map(tuple, verifiers.contamination(df, facts, block=b).collect())) for b in (10_000, 2))
    assert whole == parts and {r[1] for r in whole} == {10}


def test_values_in_pages(spark):
    cases = [
        ("$1,234", "price", "costs $ 1234 now", True), ("$12.50", "price", "only £12.50!", True), ("12.5", "price", "1,250 people", False), ("5%", "percentage", "some 5 % of", True), ("5%", "percentage", "5 of", False), ("30 hours", "duration", "runs 30 h", True), ("1.234", "count", "1234 of", True),
        ("2019", "year", "in 2019", True), ("2019", "year", "in 20190", True), ("Sony WH", "entity", "the sony wh-1", True), ("sold by the shop", "relation", "shop has it; sold by the", True), ("sold by the store", "relation", "sold by the shop", False), ("", "count", "x", False), (None, "count", "x", False), ("x", "count", None, False), ("5", "other", "55 x", True), ("7", "entity", "x", False),
    ]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, v string, k string, p string, want boolean").orderBy("i")
    assert [(r.v, r.k, r.p, r.got) for r in df.withColumn("got", numeric.value_in_page(F.col("v"), F.col("k"), F.col("p"))).collect()] == cases


def test_factual_exactness(spark):
    body = "word " * 60
    reports = spark.createDataFrame([(1, f"{body} {SHOP}/a"), (2, f"{body} {SHOP}/a"), (3, "short")], "doc_id long, md string")
    facts = spark.createDataFrame([(1, f"{SHOP}/a", "red", "entity"), (1, f"{SHOP}/a", "blue", "entity"), (1, f"{SHOP}/gone", "red", "entity"), (1, "http://else.org/", "red", "entity"), (3, f"{SHOP}/a", "red", "entity"), (1, f"{SHOP}/a", "", "entity")], "doc_id long, url string, value string, value_type string")
    pages = spark.createDataFrame([(f"{SHOP}/a", "a RED thing")], "url string, body string")
    assert rows(verifiers.factual_exactness(facts, pages, reports), "facts", "by_rule", "unfetchable", "score", "passed") == {1: (3, 1, 1, 0.3333, False), 2: (0, 0, 0, 0.0, False), 3: (1, 1, 0, 0.0, False)}
    judged = spark.createDataFrame([(1, f"{SHOP}/a", "blue", True), (1, f"{SHOP}/gone", "red", True)], "doc_id long, url string, value string, supported boolean")
    assert rows(verifiers.factual_exactness(facts, pages, reports, judged), "by_judge", "score")[1] == (1, 0.6667)


def test_claim_support(spark):
    df = spark.createDataFrame([(1, 0, f"One claim [a]({SHOP}/a). Elsewhere [b]({SHOP}/b)."), (2, 0, "none")], "doc_id long, task int, md string")
    quotes = spark.createDataFrame([(0, f"{SHOP}/a/", "a quote"), (0, f"{SHOP}/b", ""), (1, f"{SHOP}/b", "other task")], "task int, url string, quote string")
    claims = citations.citations(df).select("url", F.xxhash64("claim").alias("claim_hash"))
    found = rows(verifiers.claim_support(df, quotes, claims.withColumn("prob", F.lit(0.7))), "claims", "above", "entailed", "soft_rate", "score")
    assert found == {1: (1, 0, 1, 1.0, 0.0), 2: (0, 0, 0, 0.0, 0.0)}
    assert rows(verifiers.claim_support(df, quotes, claims.withColumn("prob", F.lit(0.8))), "score", "passed")[1] == (1.0, True)


def test_citation_alignment(spark):
    md = f"First is so [a]({SHOP}/a) and {SHOP}/b. Second is not [a]({SHOP}/a)!\n\nThird has none. First is so a and {SHOP}/b. http://else.org/"
    df = spark.createDataFrame([(1, md), (2, "")], "doc_id long, md string")
    pairs = verifiers.cited_sentences(df)
    assert {(r.sentence_at, r.url) for r in pairs.collect()} == {(0, f"{SHOP}/a"), (0, f"{SHOP}/b"), (1, f"{SHOP}/a")}
    judged = pairs.where("sentence_at = 0").select("url", F.xxhash64("sentence").alias("sentence_hash"), F.col("url").endswith("a").alias("supported"))
    assert rows(verifiers.citation_alignment(df, judged), "pairs", "supported_pairs", "fetch_failures", "recall", "score") == {1: (3, 1, 1, 0.5, 0.3333), 2: (0, 0, 0, 0.0, 0.0)}


def test_internal_consistency(spark):
    names = ["The Sony X-100 plays for thirty hours on one charge.", "Many say that Sony X-100 weighs two hundred grams.", "A third sentence names the Bose Quiet line of phones.", "Bose Quiet phones are said to be the best of all.", "Nothing with a name stands in this long sentence here.", "Again, the SONY X-100 cannot play for thirty hours.", "The Sony X-100 plays for thirty hours on one charge."]
    md = "# Title\n\n" + " ".join(names) + " filler words" * 20
    df = spark.createDataFrame([(1, md), (2, "Short."), (3, "word " * 90)], "doc_id long, md string")
    found = {(r.entity, r.i, r.j) for r in verifiers.consistency_pairs(df).collect()}
    # "The Sony X-100" is a name of its own, and its two sentences are equal, so no pair; "SONY X-100" is the same as "Sony X-100"
    assert {p for p in found if "sony" in p[0]} == {("sony x-100", 1, 5)}
    assert ("bose quiet", 2, 3) in found
    pairs = verifiers.consistency_pairs(df).select(F.xxhash64("entity", "first", "second").alias("pair_hash"), F.when(F.col("entity") == "bose quiet", "contradict").otherwise("agree").alias("verdict"))
    r = rows(verifiers.internal_consistency(df, pairs), "pairs", "contradictions", "applicable", "degenerate", "score")
    assert r[1] == (len(found), 1, True, False, round(1 - 1 / len(found), 4)) and r[2] == (0, 0, False, True, 0.0) and r[3] == (0, 0, False, False, 1.0)


def test_pairs_by_stride(spark):
    """Many sentences on one thing: pairs are drawn at even steps, as many as a judge is asked."""
    md = " ".join(f"Sentence number {k} speaks of the Sony X-100 at some length." for k in range(20))
    found = sorted((r.i, r.j) for r in verifiers.consistency_pairs(spark.createDataFrame([(1, md)], "doc_id long, md string")).collect())
    whole = list(combinations(range(20), 2))
    assert found == sorted(whole[:: len(whole) // 12][:12])


def test_citation_check(spark):
    md = f"Whales eat krill [1]({SHOP}/w). A [label of words]({SHOP}/l) and {SHOP}/bare. [x]({SHOP}/gone) [label of words]({SHOP}/l)"
    df = spark.createDataFrame([(1, md), (2, "")], "doc_id long, md string")
    pages = spark.createDataFrame([(f"{SHOP}/w", 200, "KRILL and whales"), (f"{SHOP}/l", 200, "nothing"), (f"{SHOP}/bare", 200, "x"), (f"{SHOP}/gone", 404, "x")], "url string, status int, body string")
    # four distinct URLs, one supported, three reached; recall against two sources
    assert rows(verifiers.citation_check(df, pages, min_sources=2), "citations", "supported", "sources", "precision", "recall", "score", "passed") == {1: (4, 1, 3, 0.25, 0.5, round(2 * 0.25 * 0.5 / 0.75, 3), False), 2: (0, 0, 0, 0.0, 0.0, 0.0, False)}


def test_drop_reasons(spark):
    base = {"agent": "a", "task": "t", "composite": 0.5, "reach": 0.5, "chk": 0.5, "answer_chars": 900, "cited": 3, "ck_error": False, "ad_error": False, "pres_error": False, "infra_failure": False, "head": "A report"}
    cases = [({}, None), ({"answer_chars": 0}, "short"), ({"answer_chars": 599, "reach": 0.0, "chk": None}, "short"), ({"answer_chars": 599}, None), ({"infra_failure": True}, "infra"), ({"ck_error": True, "ad_error": True, "pres_error": True}, "judge_err"), ({"ck_error": True, "ad_error": True}, None), ({"head": "  (DeerFlow produced no report after 12s, exit=1)"}, "placeholder"), ({"head": "( Storm stderr: x"}, "placeholder"), ({"answer_chars": None, "head": None}, None)]
    kind = "agent string, task string, composite double, reach double, chk double, answer_chars int, cited int, ck_error boolean, ad_error boolean, pres_error boolean, infra_failure boolean, head string"
    df = spark.createDataFrame([tuple((base | c | {"task": f"t{i}"}).values()) for i, (c, _) in enumerate(cases)], kind)
    assert [r.r for r in df.orderBy("task").select(filters.drop_reason().alias("r")).collect()] == [w for _, w in cases]
    r = filters.drop_counts(df).first()
    assert (r.total, r.kept, r.degenerate, r.short, r.infra, r.judge_err, r.placeholder) == (10, 4, 6, 2, 1, 1, 2)
