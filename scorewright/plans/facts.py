"""Queries over facts, claims and judgements of reports; judgements are made by rule from hashes, as a model's would be a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewright.functions import numeric, text
from scorewright.operators import citations as cited
from scorewright.operators import verifiers
from scorewright.plans import views
from scorewright.plans.texts import HOSTS
from scorewright.plans.views import REPORTS_SQL
from scorewright.registry import query, table
from scorewright.storage import materialised

#: Planted changes of articles: a topic, what was known before, what the sandbox says.
PLANTED = [("Report", "the", "Findings"), ("One", "better", "nowhere to be found"), ("audio", "whereas", "differ"), ("nowhere", "the", "Sources"), ("Sources", "", "one")]
_LOW = lambda c: rf"regexp_replace(lower({c}), '\s+', ' ', 'g')"
_PLANTED = ", ".join(f"('{t}', '{p}', '{s}')" for t, p, s in PLANTED)


@query("contamination", rf"""WITH {REPORTS_SQL}, facts AS (SELECT * FROM (VALUES {_PLANTED}) AS v(topic, prior, planted)), w AS (SELECT doc_id, md, {_LOW('md')} AS low, topic, prior, planted, string_split({_LOW('md')}, lower(topic)) AS gaps FROM reports, facts),
p AS (SELECT *, list_transform(range(1, len(gaps)), lambda i: CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + (i - 1) * length(topic) AS BIGINT)) AS places FROM w),
s AS (SELECT doc_id, topic, prior, planted, len(gaps) > 1 AS named, CASE WHEN len(gaps) > 1 THEN list_transform(places, lambda i: substr(md, greatest(i - 600, 0) + 1, i + length(topic) + 600 - greatest(i - 600, 0))) ELSE [md] END AS spots FROM p),
v AS (SELECT doc_id, named, prior <> '' AND list_bool_or(list_transform(spots, lambda x: contains({_LOW('x')}, lower(prior)))) AS p, planted <> '' AND list_bool_or(list_transform(spots, lambda x: contains({_LOW('x')}, lower(planted)))) AS q FROM s),
k AS (SELECT doc_id, CASE WHEN q AND NOT p THEN 'sandbox' WHEN p AND NOT q THEN 'prior' WHEN p THEN 'both' WHEN named THEN 'neither' ELSE 'topic_not_referenced' END AS verdict FROM v),
n AS (SELECT doc_id, count(*) AS facts, count(*) FILTER (verdict = 'sandbox') AS sandbox, count(*) FILTER (verdict = 'prior') AS prior, count(*) FILTER (verdict = 'both') AS "both", count(*) FILTER (verdict = 'neither') AS neither, count(*) FILTER (verdict = 'topic_not_referenced') AS topic_not_referenced FROM k GROUP BY 1)
SELECT *, round(coalesce((sandbox + 0.5 * "both") / nullif(facts - topic_not_referenced, 0), 0), 4) AS score, coalesce((sandbox + 0.5 * "both") / nullif(facts - topic_not_referenced, 0), 0) >= 0.5 AS passed FROM n""")  # fmt: skip
def contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verifiers.contamination(views.reports(spark, sf_dir), spark.createDataFrame(PLANTED, "topic string, prior_value string, sandbox_value string"))


_KINDS = ("price", "percentage", "count", "year", "relation", "entity")
_NUM = r"-?[0-9]+(?:[.,][0-9]+)?"
_CANON_NUM = lambda c: f"CASE WHEN regexp_matches({c}, '^-?[0-9]+\\.[0-9]{{1,2}}$') THEN {c} ELSE regexp_replace({c}, '[.,]', '', 'g') END"
_FIRST = lambda c: f"nullif(regexp_extract({c}, '{_NUM}', 0), '')"
_AMONG = lambda pattern: f"coalesce(list_contains(list_transform(regexp_extract_all(body, '{pattern}', 1), lambda x: {_CANON_NUM('x')}), {_CANON_NUM(_FIRST('value'))}), false)"


@query("values_in_pages", rf"""WITH v AS (SELECT p_partkey, CAST(p_partkey % 6 AS INT) AS k, CASE p_partkey % 6 WHEN 0 THEN '$' || p_size || '.50' WHEN 1 THEN p_size || '%' WHEN 2 THEN p_size || ' units' WHEN 3 THEN CAST(1980 + p_size AS VARCHAR) WHEN 4 THEN lower(p_brand) || ' in ' || p_type ELSE upper(p_name) END AS value,
p_name || ' costs $ ' || p_size || '.50 or 1,' || p_size || ' for ' || (p_size + p_partkey % 2) || '% of ' || p_brand || ', ' || p_type || ' since ' || (1980 + p_size) AS body FROM part)
SELECT p_partkey, CASE k {' '.join(f"WHEN {i} THEN '{kind}'" for i, kind in enumerate(_KINDS))} END AS kind, contains(lower(body), lower(value)) OR CASE k WHEN 0 THEN {_AMONG('[$£€¥]\\s?([0-9]+(?:[.,][0-9]+)?)')} WHEN 1 THEN {_AMONG('([0-9]+(?:[.,][0-9]+)?)\\s*%')} WHEN 2 THEN {_AMONG(f'({_NUM})')}
 WHEN 4 THEN list_bool_and(list_transform(list_filter(regexp_split_to_array(lower(value), '\s+'), lambda w: length(w) >= 3)[1:8], lambda w: contains(lower(body), w))) ELSE false END AS found FROM v""")  # fmt: skip
def values_in_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of six kinds against a page made of a part's columns."""
    k, size = F.col("p_partkey") % 6, F.col("p_size").cast("string")
    value = F.when(k == 0, F.concat(F.lit("$"), size, F.lit(".50"))).when(k == 1, F.concat(size, F.lit("%"))).when(k == 2, F.concat(size, F.lit(" units"))).when(k == 3, (1980 + F.col("p_size")).cast("string")).when(k == 4, F.concat(F.lower("p_brand"), F.lit(" in "), "p_type")).otherwise(F.upper("p_name"))
    body = F.concat("p_name", F.lit(" costs $ "), size, F.lit(".50 or 1,"), size, F.lit(" for "), (F.col("p_size") + F.col("p_partkey") % 2).cast("string"), F.lit("% of "), "p_brand", F.lit(", "), "p_type", F.lit(" since "), (1980 + F.col("p_size")).cast("string"))
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (k + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", kind.alias("kind"), numeric.value_in_page(value, kind, body).alias("found"))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", "url", text.html_text(F.col("html")).alias("body"))


@query("factual_exactness")
def factual_exactness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts that reports give on the pages they cite: a page's own first word or a made-up one, by the report's id."""
    reports, pages = views.reports(spark, sf_dir), _pages(spark, sf_dir)
    links = cited.citations(reports, list(HOSTS), wanted=("raw_url",)).select("doc_id", F.col("raw_url").alias("url")).distinct().join(pages.groupBy("url").agg(F.min("body").alias("body")), "url", "left")
    value = F.when(F.col("doc_id") % 3 == 0, F.lit("no such value")).otherwise(F.coalesce(F.split_part("body", F.lit(" "), F.lit(2)), F.lit("x")))
    return verifiers.factual_exactness(links.select("doc_id", "url", value.alias("value"), F.lit("entity").alias("value_type")), pages.where("page_id % 5 != 1"), reports, hosts=list(HOSTS))


@query("claim_support")
def claim_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes of every second page; the judge's probability comes from the claim's hash."""
    reports = views.reports(spark, sf_dir)
    quotes = table(spark, sf_dir, "pages").where("page_id % 2 = 0").select(F.explode(F.array(*map(F.lit, (0, 1, 2)))).alias("task"), "url", F.lit("a quote").alias("quote"))
    claims = cited.citations(reports, list(HOSTS), wanted=("url", "claim")).select("url", F.xxhash64("claim").alias("claim_hash")).distinct()
    judged = claims.withColumn("prob", F.pmod("claim_hash", F.lit(100)) / 100)
    return verifiers.claim_support(reports, quotes, judged, list(HOSTS))


@query("citation_alignment")
def citation_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The judge supports two of three sentences by their hash, and one in ten pages could not be fetched."""
    reports = views.reports(spark, sf_dir)
    pairs = verifiers.cited_sentences(reports, list(HOSTS)).select("url", F.xxhash64("sentence").alias("sentence_hash")).distinct()
    judged = pairs.where(F.pmod(F.xxhash64("url"), F.lit(10)) != 0).withColumn("supported", F.pmod("sentence_hash", F.lit(3)) != 0)
    return verifiers.citation_alignment(reports, judged, list(HOSTS))


@query("internal_consistency")
def internal_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of sentences on one thing; every fifth contradicts by its hash."""
    reports = views.reports(spark, sf_dir)
    pairs = materialised(verifiers.consistency_pairs(reports).select("doc_id", "entity", "first", "second"))
    hashes = pairs.select(F.xxhash64("entity", "first", "second").alias("pair_hash")).distinct()
    return verifiers.internal_consistency(reports, hashes.withColumn("verdict", F.when(F.pmod("pair_hash", F.lit(5)) == 0, "CONTRADICT").otherwise("AGREE")), pairs=pairs)


@query("citation_check")
def citation_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _pages(spark, sf_dir).select("url", F.when(F.col("page_id") % 7 == 0, 404).otherwise(200).alias("status"), "body")
    return verifiers.citation_check(views.reports(spark, sf_dir), pages, min_sources=2)


@query("heading_entities", f"""WITH {REPORTS_SQL}, t AS (SELECT doc_id, unnest(regexp_extract_all(md, '(?m)^###\\s+(.+?)\\s*$', 1)) AS title FROM reports),
b AS (SELECT DISTINCT doc_id, trim(regexp_replace(title, '^[(\\[]?\\d+[)\\].:\\-]?\\s*', '')) AS entity FROM t) SELECT doc_id, entity FROM b WHERE length(entity) BETWEEN 3 AND 80""")  # fmt: skip
def heading_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verifiers.heading_entities(views.reports(spark, sf_dir))
