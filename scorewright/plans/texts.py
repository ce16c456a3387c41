"""Queries over URLs, pages, prose and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewright.functions import numeric, text, url
from scorewright.operators import citations as cited
from scorewright.operators import verifiers
from scorewright.plans import views
from scorewright.plans.views import REPORTS_SQL
from scorewright.registry import query, table

_PATH = "regexp_extract(u, '^[A-Za-z]+://[^/?#]+([^?#]*)', 1)"
_CANON = rf"""(regexp_extract(u, '^[a-z]+://[^/?#]+', 0) || CASE WHEN {_PATH} IN ('', '/') THEN '/' ELSE regexp_replace({_PATH}, '/+$', '') END ||
 CASE WHEN regexp_extract(u, '\?([^#]*)', 1) = '' THEN '' ELSE '?' || array_to_string(list_sort(string_split(regexp_extract(u, '\?([^#]*)', 1), '&')), '&') END)"""
_HOST = "regexp_extract(u, '^[a-z]+://([^/?#]+)', 1)"
_DOMAIN = f"regexp_extract(regexp_replace({_HOST}, '^www\\.', ''), '[^.]+\\.[^.]+$', 0)"
_WORDS = lambda c: f"len(regexp_extract_all({c}, '[A-Za-z0-9]+'))"
_TOKENS = lambda c: rf"len(list_filter(regexp_split_to_array({c}, '\s+'), lambda x: x <> ''))"
_STRIP = lambda c: rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"
_TRAIL = r"""'[).,;:`''"\\!?>\]}]+$'"""
#: Citations as SQL: where each form's matches stand, then the URL that a match is or names; the first form at a place counts.
_FORMS = [
    ("markdown", r"'\[[^\]]*\]\(https?://[^)\s]+\)'", "regexp_extract(hit, '\\((https?://[^)\\s]+)\\)$', 1)", "0"),
    ("source", r"'(?i)\b(?:Source|URL|Link|See|Reference|Ref|Available\s+at|Cited\s+from)\s*[:=]\s*https?://\S+'", "regexp_extract(hit, 'https?://.*$', 0)", "strpos(hit, 'http') - 1"),
    ("bullet", r"'(?m)^[-*+]\s+https?://\S+\s*$'", "regexp_extract(hit, 'https?://\\S+', 0)", "strpos(hit, 'http') - 1"),
    ("numbered", r"'\[\d{1,3}\]'", "", "0"),
    ("footnote", r"'\[\^[\w-]+\]'", "", "0"),
    ("bare", r"""'https?://[^\s<>"''`)\]]+'""", "hit", "0"),
]
_REFS = {"numbered": r"'(?m)^\s*\[(\d{1,3})\]\s*\.?\s*(?:[-:.]\s*)?(.+)$'", "footnote": r"'(?m)^\s*\[\^([\w-]+)\]:\s*(.+)$'"}


def _form_sql(rank: int, style: str, pattern: str, target: str, shift: str) -> str:
    poss = f"SELECT doc_id, md, unnest(range(1, len(hits) + 1)) AS i, hits, gaps FROM (SELECT doc_id, md, regexp_extract_all(md, {pattern}) AS hits, string_split_regex(md, {pattern}) AS gaps FROM reports)"
    found = f"SELECT doc_id, md, hits[i] AS hit, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i-1], lambda x: length(x))), 0) AS pos FROM ({poss})"
    if style in _REFS:
        line = _REFS[style]
        refs = f"SELECT doc_id, name, arg_max(CASE WHEN bare <> '' THEN bare ELSE regexp_extract(rest, '\\]\\((https?://[^)\\s]+)\\)', 1) END, k) AS raw FROM (SELECT doc_id, k, names[k] AS name, rests[k] AS rest, regexp_extract(' ' || rests[k], '[^(\\[](https?://[^\\s<>\"''`)\\]]+)', 1) AS bare FROM (SELECT doc_id, unnest(range(1, len(names) + 1)) AS k, names, rests FROM (SELECT doc_id, regexp_extract_all(md, {line}, 1) AS names, regexp_extract_all(md, {line}, 2) AS rests FROM reports))) GROUP BY 1, 2"
        return f"SELECT f.doc_id, pos AS place, {rank} AS rank, '{style}' AS style, raw FROM ({found}) f JOIN ({refs}) r ON r.doc_id = f.doc_id AND r.name = regexp_extract(hit, '^\\[\\^?([^\\]]*)\\]$', 1)"
    alone = " WHERE pos = 0 OR substr(md, CAST(pos AS BIGINT), 1) NOT IN ('(', '[')" if style == "bare" else ""
    return f"SELECT doc_id, pos + {shift} AS place, {rank} AS rank, '{style}' AS style, {target} AS raw FROM ({found}){alone}"


_CITED = f"""forms AS ({' UNION ALL '.join(_form_sql(k, *form) for k, form in enumerate(_FORMS))}), trimmed AS (SELECT doc_id, place, rank, style, regexp_replace(raw, {_TRAIL}, '') AS u FROM forms),
cu AS (SELECT doc_id, CAST(place AS BIGINT) AS place, style, u AS raw_url, {_CANON} AS url FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, place ORDER BY rank) AS r FROM trimmed WHERE u <> '') WHERE r = 1)"""
#: Hosts of the given pages that stand for a sandbox, with what kind of source each is.
HOSTS = {"blog.tionsh.example.net": "shopping", "m.tionsh.example.net": "shopping", "thther.example.com": "reddit", "blog.ththsh.example.com": "wiki", "m.therha.example.com": "shopping", "thther.example.org": "reddit", "blog.ththan.example.net": "reddit", "blog.tiontion.example.com": "wiki", "m.ththth.example.net": "wiki", "localhost:9999": "reddit"}
_INSIDE = f"regexp_extract(u, '^[a-z]+://([^/?#]+)', 1) IN ({', '.join(map(repr, HOSTS))})"
_OF = lambda column, sql: sql.replace("u,", f"{column},")


@query("url_parts", f"WITH p AS (SELECT page_id, url AS u FROM pages) SELECT page_id, {_CANON} AS canonical, {_HOST} AS host, {_DOMAIN} AS domain FROM p")
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", url.canonical(u).alias("canonical"), url.host(u).alias("host"), url.domain(u).alias("domain"))


@query("pages_per_domain", f"WITH p AS (SELECT page_id, url AS u FROM pages) SELECT {_DOMAIN} AS domain, count(*) AS pages, count(DISTINCT {_HOST}) AS hosts, count(DISTINCT {_CANON}) AS urls FROM p GROUP BY 1")
def pages_per_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf_dir, "pages").groupBy(url.domain(u).alias("domain")).agg(F.count("*").alias("pages"), F.count_distinct(url.host(u)).alias("hosts"), F.count_distinct(url.canonical(u)).alias("urls"))


_HTML = "html"
for _tag in ("script", "style", "nav", "footer", "header", "noscript", "aside", "svg"):
    _HTML = rf"regexp_replace({_HTML}, '(?is)<{_tag}\b.*?</{_tag}\s*>', ' ', 'g')"


@query("page_text", rf"WITH t AS (SELECT page_id, trim(regexp_replace(regexp_replace({_HTML}, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS body FROM pages) SELECT page_id, length(body) AS n_chars, sha256(body) AS body_sha256 FROM t")
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = text.html_text(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.char_length(body).cast("long").alias("n_chars"), F.sha2(body, 256).alias("body_sha256"))


@query("page_titles", r"SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', '', 'g')) AS title FROM pages")
def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.html_title(F.col("html")).alias("title"))


_LISTED = lambda words: "(" + ", ".join(f"'{w}'" for w in words) + ")"
_LEXICON = lambda c: ", ".join(rf"len(list_filter(regexp_split_to_array(lower({c}), '[^\p{{L}}\p{{N}}_\-]+'), lambda x: x IN {_LISTED(words)})) AS {name}" for name, words in (("positive", text.POSITIVE), ("negative", text.NEGATIVE)))


@query("prose_measures", rf"SELECT doc_id, {_WORDS('text')} AS words, len(list_filter(regexp_split_to_array(text, '[.!?]+'), lambda x: {_STRIP('x')} <> '')) AS sentences, {_TOKENS('text')} AS tokens, {_LEXICON('text')} FROM documents")
def prose_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    out = table(spark, sf_dir, "documents").select("doc_id", text.ascii_words(t).alias("words"), text.sentences(t).alias("sentences"), text.tokens(t).alias("tokens"), text.lexicon_counts(t).alias("n"))
    return out.select("doc_id", *(F.col(c).cast("long").alias(n) for n, c in (("words", "words"), ("sentences", "sentences"), ("tokens", "tokens"), ("positive", "n.positive"), ("negative", "n.negative"))))


_EASE = lambda c: rf"CASE WHEN len(regexp_extract_all({c}, '[a-zA-Z]+')) = 0 THEN 0.0 ELSE 206.835 - 1.015 * (len(regexp_extract_all({c}, '[a-zA-Z]+')) / len(list_filter(regexp_split_to_array({c}, '[.!?]+'), lambda x: {_STRIP('x')} <> ''))) - 84.6 * (list_sum(list_transform(regexp_extract_all(lower({c}), '[a-z]+'), lambda w: greatest(1, len(regexp_extract_all(CASE WHEN length(w) > 2 THEN regexp_replace(w, 'e$', '') ELSE w END, '[aeiouy]+'))))) / len(regexp_extract_all({c}, '[a-zA-Z]+'))) END"


@query("reading_ease", f"SELECT doc_id, round({_EASE('text')}, 4) AS ease FROM documents")
def reading_ease(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.round(text.reading_ease(F.col("text")), 4).alias("ease"))


@query("markdown_contract", rf"""WITH {REPORTS_SQL}, n AS (SELECT doc_id, len(regexp_extract_all(md, '[\p{{L}}\p{{N}}\p{{M}}_''-]*[\p{{L}}\p{{N}}\p{{M}}_][\p{{L}}\p{{N}}\p{{M}}_''-]*')) AS words, len(list_filter(regexp_split_to_array(md, '\n\s*\n'), lambda x: {_STRIP('x')} <> '')) AS paragraphs, len(regexp_extract_all(md, '\[[^\]]+\]\([^)\s]+\)')) AS citations FROM reports),
c AS (SELECT *, CAST(words >= 50 AS INT) AS w, CASE WHEN words <= 300 THEN 1.0 ELSE greatest(0, 1 - (words - 300) / 300 / 0.2) END AS m, CAST(paragraphs >= 3 AS INT) AS p, CAST(citations >= 1 AS INT) AS k FROM n)
SELECT doc_id, words, paragraphs, citations, CAST(NULL AS BIGINT) AS pages, CAST(w AS DOUBLE) AS enough_words, round(m, 3) AS not_too_many, CAST(p AS DOUBLE) AS enough_paragraphs, CAST(k AS DOUBLE) AS enough_citations, 1.0::DOUBLE AS enough_pages, round((w + m + p + k + 1) / 5, 3) AS score, w = 1 AND m >= 0.999 AND p = 1 AND k = 1 AS passed FROM c""")  # fmt: skip
def markdown_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verifiers.markdown_contract(views.reports(spark, sf_dir), min_words=50, max_words=300, min_paragraphs=3, min_citations=1, min_pages=2)


_RE2 = lambda pattern: pattern.replace("(?iU)", "(?i)")
_LABELS = "list_filter(list_distinct(list_transform(urls, lambda u: CASE WHEN regexp_matches(u, '^[a-z]+://(localhost|127.0.0.1):') THEN regexp_extract(u, '^[a-z]+://([^/?#]+)', 1) ELSE regexp_extract(regexp_replace(regexp_extract(u, '^[a-z]+://([^/?#:]+)', 1), '^www\\.', ''), '[^.]+(\\.[^.]+)?$', 0) END)), lambda d: d <> '')"


@query("analysis_depth", rf"""WITH {REPORTS_SQL}, p AS (SELECT doc_id, unnest(list_filter(list_transform(string_split_regex(md, '\n\s*\n'), lambda x: {_STRIP('x')}), lambda x: length(x) > 20)) AS b FROM reports),
u AS (SELECT doc_id, b, list_filter(list_distinct(list_transform(list_concat(regexp_extract_all(b, '\[[^\]]*\]\((https?://[^)\s]+)\)', 1), regexp_extract_all(' ' || b, '[^(\[](https?://[^\s<>"''`)\]]+)', 1)), lambda x: regexp_replace(x, {_TRAIL}, ''))), lambda x: x <> '') AS urls FROM p),
m AS (SELECT doc_id, len(urls) AS n, len({_LABELS}) AS d, regexp_matches(b, '{_RE2(text.CONTRADICTION)}') AS a, regexp_matches(b, '{_RE2(text.COMPARATIVE)}') AS c FROM u),
g AS (SELECT r.doc_id, count(m.doc_id) AS paragraphs, count(*) FILTER (d >= 2) AS cross_source, count(*) FILTER (a) AS contradictions, count(*) FILTER (d >= 2 AND n >= 3) AS chains, round(coalesce(count(*) FILTER (c) / nullif(count(m.doc_id), 0), 0), 3) AS density FROM reports r LEFT JOIN m ON m.doc_id = r.doc_id GROUP BY 1),
t AS (SELECT *, (CAST(cross_source >= 1 AS INT) + CAST(contradictions >= 3 AS INT) + CAST(chains >= 3 AS INT) + CAST(density >= 0.15 AS INT)) / 4 AS s FROM g) SELECT doc_id, paragraphs, cross_source, contradictions, chains, density, round(s, 4) AS score, s >= 0.5 AS passed FROM t""")  # fmt: skip
def analysis_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verifiers.analysis_depth(views.reports(spark, sf_dir))


@query("presentation", rf"""WITH {REPORTS_SQL}, s AS (SELECT doc_id, md, string_split_regex(chr(10) || md, '\n##\s') AS p FROM reports),
z AS (SELECT doc_id, md, list_transform(list_filter(list_concat([{_STRIP('p[1]')}], list_transform(p[2:], lambda x: {_STRIP(r"regexp_replace(x, '^\s*[^\n]*', '')")})), lambda x: x <> ''), lambda x: {_TOKENS('x')}) AS sizes FROM s),
g AS (SELECT doc_id, len(list_distinct(list_transform(regexp_extract_all(md, '(?m)^(#{{1,6}})\s+\S', 1), lambda x: length(x)))) AS levels, len(sizes) AS sections, round(CASE WHEN coalesce(list_sum(sizes), 0) = 0 THEN 0 ELSE list_stddev_pop(sizes) / list_avg(sizes) END, 3) AS variation, regexp_matches(md, '(?m)^\s*[-*+]\s|\d+\.\s|^\|.+\|') AS listed, CAST({_TOKENS(r"string_split_regex(md, '(?m)^#{1,6}\s+.*$')[1]")} > 200 AS INT) AS orphans, round({_EASE('md')}, 1) AS ease FROM z),
t AS (SELECT *, (CAST(levels >= 3 AS INT) + CAST(sections >= 5 AS INT) + CAST(variation < 1.5 AND sections > 0 AS INT) + CAST(listed AS INT) + CAST(orphans = 0 AS INT) + CAST(ease >= 30 AS INT)) / 6 AS s FROM g) SELECT doc_id, levels, sections, variation, listed, orphans, ease, round(s, 4) AS score, s >= 0.5 AS passed FROM t""")  # fmt: skip
def presentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verifiers.presentation(views.reports(spark, sf_dir))


@query("citations", f"WITH {REPORTS_SQL}, {_CITED} SELECT doc_id, place, style, raw_url, url FROM cu")
def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cited.citations(views.reports(spark, sf_dir)).select("doc_id", F.col("at").cast("long").alias("place"), "style", "raw_url", "url")


@query("claims", f"""WITH {REPORTS_SQL}, {_CITED}, w AS (SELECT doc_id, place, regexp_replace(substr(md, greatest(place - 200, 0) + 1, CAST(place + 200 - greatest(place - 200, 0) AS BIGINT)), '\\[([^\\]]*)\\]\\(https?://[^)\\s]+\\)', '\\1', 'g') AS c FROM cu JOIN reports USING (doc_id))
SELECT doc_id, place, sha256({_STRIP("regexp_replace(regexp_replace(c, '`[^`]*`', ' ', 'g'), '\\s+', ' ', 'g')")}) AS claim_sha256 FROM w""")  # fmt: skip
def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cited.citations(views.reports(spark, sf_dir)).select("doc_id", F.col("at").cast("long").alias("place"), F.sha2("claim", 256).alias("claim_sha256"))


_BARE = lambda c: rf"regexp_replace(regexp_replace(regexp_replace({c}, '\[([^\]]*)\]\([^)]+\)', '\1', 'g'), '`[^`]*`', ' ', 'g'), '[#>*_~]', ' ', 'g')"


@query("degenerate_reports", rf"""WITH {REPORTS_SQL}, {_CITED}, r AS (SELECT doc_id, {_STRIP('md')} AS s FROM reports), n AS (SELECT doc_id, s, {_TOKENS(_BARE('s'))} AS words FROM r), k AS (SELECT DISTINCT doc_id FROM cu)
SELECT n.doc_id, s = '' OR words < 50 OR k.doc_id IS NULL AS degenerate, CASE WHEN s = '' THEN 'empty_answer' WHEN words < 50 THEN 'word_count_too_low:' || words WHEN k.doc_id IS NULL THEN 'zero_citations' ELSE '' END AS reason FROM n LEFT JOIN k ON k.doc_id = n.doc_id""")
def degenerate_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verifiers.degenerate(views.reports(spark, sf_dir))


_DOMAINS = {"com": (["www.ththhe.example.com", "blog.tiontion.example.com", "ththre.example.com"], 1), "org": (["thther.example.org", "ththed.example.org"], 2)}
_IN = lambda hosts: f"regexp_extract(d.url, '^[a-z]+://([^/?#]+)', 1) IN ({', '.join(map(repr, hosts))})"
_MUST = f"pg AS (SELECT page_id, {_CANON} AS url FROM (SELECT page_id, url AS u FROM pages)), must AS (SELECT page_id % 3 AS task, url, max(CAST(1 + page_id % 4 AS DOUBLE)) AS weight FROM pg WHERE page_id % 5 = 0 AND page_id % 3 < 2 GROUP BY 1, 2), pool AS (SELECT DISTINCT page_id % 3 AS task, url FROM pg WHERE page_id % 2 = 0)"


@query("url_coverage", f"""WITH {REPORTS_SQL}, {_CITED}, {_MUST}, mt AS (SELECT task, sum(weight) AS tw, count(*) AS n FROM must GROUP BY 1), pt AS (SELECT task, count(*) AS n FROM pool GROUP BY 1), d AS (SELECT DISTINCT cu.doc_id, cu.url, reports.task FROM cu JOIN reports USING (doc_id)),
f AS (SELECT d.doc_id, count(*) AS cited, count(must.url) AS must_hit, coalesce(sum(weight), 0) AS w, count(pool.url) AS pool_hit, {', '.join(f"count(*) FILTER ({_IN(h)}) AS cited_{n}" for n, (h, _) in _DOMAINS.items())} FROM d LEFT JOIN must ON must.url = d.url AND must.task = d.task LEFT JOIN pool ON pool.url = d.url AND pool.task = d.task GROUP BY 1),
g AS (SELECT r.doc_id, coalesce(cited, 0) AS cited, coalesce(mt.n, 0) AS must_total, coalesce(must_hit, 0) AS must_hit, coalesce(pt.n, 0) AS pool_total, coalesce(pool_hit, 0) AS pool_hit, {', '.join(f"coalesce(cited_{n}, 0) AS cited_{n}" for n in _DOMAINS)}, coalesce(w / tw, 0) AS recall, coalesce(pool_hit / pt.n, 0) AS share, least({', '.join(f"least(1, coalesce(cited_{n}, 0) / {k})" for n, (_, k) in _DOMAINS.items())}) AS balance FROM reports r LEFT JOIN f ON f.doc_id = r.doc_id LEFT JOIN mt ON mt.task = r.task LEFT JOIN pt ON pt.task = r.task)
SELECT doc_id, cited, must_total, must_hit, round(recall, 4) AS must_recall, pool_total, pool_hit, round(share, 4) AS pool_share, {', '.join(f'cited_{n}' for n in _DOMAINS)}, round(balance, 4) AS domain_balance, round(CASE WHEN must_total = 0 THEN 0 ELSE 0.55 * recall + 0.15 * share + 0.3 * balance END + 1e-9, 4) AS score, must_total > 0 AND recall >= 0.01 AND share >= 0 AND balance >= 0.5 AND cited >= 1 AS passed FROM g""")  # fmt: skip
def url_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").withColumn("task", F.col("page_id") % 3)
    must = pages.where("page_id % 5 = 0 and task < 2").select("task", "url", (1 + F.col("page_id") % 4).cast("double").alias("weight"))
    return verifiers.url_coverage(views.reports(spark, sf_dir), must, pages.where("page_id % 2 = 0").select("task", "url"), _DOMAINS, 0.01, 0.0, 1, 0.5)


@query("url_reachability", f"""WITH {REPORTS_SQL}, {_CITED}, st AS (SELECT url, max(CASE page_id % 10 WHEN 7 THEN 404 WHEN 8 THEN 500 WHEN 9 THEN 0 WHEN 6 THEN 429 ELSE 200 END) AS code FROM (SELECT page_id, {_CANON} AS url FROM (SELECT page_id, url AS u FROM pages)) GROUP BY 1),
d AS (SELECT DISTINCT doc_id, url, {_INSIDE.replace('(u,', '(url,')} AS inside FROM cu),
f AS (SELECT d.doc_id, count(*) AS cited, count(*) FILTER (inside) AS cited_inside, count(*) FILTER (inside AND code = 200) AS ok, count(*) FILTER (inside AND code IN (400, 401, 403, 404, 410)) AS broken, count(*) FILTER (inside AND code BETWEEN 500 AND 599) AS server, count(*) FILTER (inside AND coalesce(code, 0) = 0) AS "none" FROM d LEFT JOIN st ON st.url = d.url GROUP BY 1),
g AS (SELECT r.doc_id, coalesce(cited, 0) AS cited, coalesce(cited_inside, 0) AS cited_inside, coalesce(ok, 0) AS ok, coalesce(broken, 0) AS broken, coalesce(server, 0) AS server, coalesce("none", 0) AS "none" FROM reports r LEFT JOIN f ON f.doc_id = r.doc_id)
SELECT *, round(coalesce(ok / nullif(cited_inside - server - "none", 0), 0), 4) AS score, cited_inside > 0 AND coalesce(ok / nullif(cited_inside - server - "none", 0), 0) >= 0.3 AS passed, cited_inside > 0 AND cited_inside = server + "none" AS infra_failure, cited_inside > 0 AND server + "none" >= 0.3 * cited_inside AS infra_warning FROM g""")  # fmt: skip
def url_reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.when(F.col("page_id") % 10 == 7, 404).when(F.col("page_id") % 10 == 8, 500).when(F.col("page_id") % 10 == 9, 0).when(F.col("page_id") % 10 == 6, 429).otherwise(200)
    return verifiers.url_reachability(views.reports(spark, sf_dir), table(spark, sf_dir, "pages").select("url", code.alias("code")), list(HOSTS))


@query("source_diversity", f"""WITH {REPORTS_SQL}, {_CITED}, h AS (SELECT doc_id, raw_url, regexp_extract(raw_url, '^[a-z]+://([^/?#]+)', 1) AS host, {_INSIDE.replace('(u,', '(raw_url,')} AS inside FROM cu),
k AS (SELECT doc_id, host, count(*) AS n, CASE host {' '.join(f"WHEN '{h}' THEN '{t}'" for h, t in HOSTS.items())} END AS kind FROM h WHERE inside GROUP BY 1, 2),
t AS (SELECT doc_id, count(*) AS citations, count(*) FILTER (inside) AS inside, count(DISTINCT CASE WHEN inside THEN nullif(lower(regexp_extract(raw_url, '/f/([A-Za-z0-9_\\-]+)/', 1)), '') END) AS subforums FROM h GROUP BY 1),
s AS (SELECT doc_id, count(*) AS hosts, max(n) / sum(n) AS top, sum(n) AS total, coalesce(sum(n) FILTER (kind = 'shopping'), 0) AS s, coalesce(sum(n) FILTER (kind = 'reddit'), 0) AS r, coalesce(sum(n) FILTER (kind = 'wiki'), 0) AS w FROM k GROUP BY 1),
e AS (SELECT k.doc_id, -sum(n / total * ln(n / total)) / nullif(ln(any_value(hosts)), 0) AS entropy FROM k JOIN s ON s.doc_id = k.doc_id GROUP BY 1),
g AS (SELECT reports.doc_id, coalesce(citations, 0) AS citations, coalesce(inside, 0) AS inside, coalesce(hosts, 0) AS hosts, coalesce(subforums, 0) AS subforums, coalesce(entropy, 0) AS entropy, coalesce(top, 0) AS top_share, CASE WHEN coalesce(inside, 0) = 0 THEN 0 ELSE least(1, greatest(0, (0.6 - top) / 0.25)) END AS top_score, least(coalesce(s, 0), coalesce(r, 0), coalesce(w, 0), 1) / 1 AS type_balance, least(1, coalesce(subforums, 0) / 3) AS subforum_diversity FROM reports LEFT JOIN t ON t.doc_id = reports.doc_id LEFT JOIN s ON s.doc_id = reports.doc_id LEFT JOIN e ON e.doc_id = reports.doc_id)
SELECT doc_id, citations, inside, hosts, subforums, round(entropy, 4) AS entropy, round(top_share, 4) AS top_share, round(top_score, 4) AS top_score, round(type_balance, 4) AS type_balance, round(subforum_diversity, 4) AS subforum_diversity, round(CASE WHEN inside = 0 THEN 0 ELSE 0.35 * entropy + 0.25 * top_score + 0.25 * type_balance + 0.15 * subforum_diversity END + 1e-9, 4) AS score, inside > 0 AND 0.35 * entropy + 0.25 * top_score + 0.25 * type_balance + 0.15 * subforum_diversity >= 0.3 AS passed FROM g""")  # fmt: skip
def source_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verifiers.source_diversity(views.reports(spark, sf_dir), HOSTS, {"shopping": 1, "reddit": 1, "wiki": 1}, min_score=0.3)


@query("compliance", f"""WITH {REPORTS_SQL}, {_CITED}, f AS (SELECT doc_id, url, arg_min(raw_url, place) AS u FROM cu GROUP BY 1, 2), c AS (SELECT doc_id, count(*) AS urls, count(*) FILTER ({_INSIDE}) AS allowed FROM f GROUP BY 1)
SELECT r.doc_id, coalesce(urls, 0) AS urls, coalesce(allowed, 0) AS allowed, round(coalesce(allowed / urls, 1), 6) AS score, coalesce(allowed = urls, true) AS passed FROM reports r LEFT JOIN c ON c.doc_id = r.doc_id""")  # fmt: skip
def compliance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verifiers.compliance(views.reports(spark, sf_dir), list(HOSTS))


_CONTENT = lambda c: f"list_filter(list_distinct(regexp_extract_all(lower({c}), '[a-z0-9]{{3,}}')), lambda x: x NOT IN {_LISTED(text.STOP_WORDS)})"


@query("quote_match", f"""WITH {REPORTS_SQL}, {_CITED}, w AS (SELECT doc_id, raw_url, {_STRIP("regexp_replace(regexp_replace(regexp_replace(substr(md, greatest(place - 200, 0) + 1, CAST(place + 200 - greatest(place - 200, 0) AS BIGINT)), '\\[([^\\]]*)\\]\\(https?://[^)\\s]+\\)', '\\1', 'g'), '`[^`]*`', ' ', 'g'), '\\s+', ' ', 'g')")} AS claim FROM cu JOIN reports USING (doc_id) WHERE {_INSIDE.replace('(u,', '(raw_url,')}),
p AS (SELECT url, min(trim(regexp_replace(regexp_replace({{html}}, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))) AS body FROM pages GROUP BY 1), c AS (SELECT doc_id, {_CONTENT('claim')} AS cw, {_CONTENT('body')} AS pw, body FROM w LEFT JOIN p ON p.url = w.raw_url),
f AS (SELECT doc_id, count(*) AS claims, count(*) FILTER (body IS NOT NULL AND len(cw) > 0 AND len(list_intersect(cw, pw)) / len(cw) >= 0.1) AS supported, count(*) FILTER (body IS NULL) AS unreachable FROM c GROUP BY 1)
SELECT r.doc_id, coalesce(claims, 0) AS claims, coalesce(supported, 0) AS supported, coalesce(unreachable, 0) AS unreachable, round(coalesce(supported / claims, 0), 4) AS score, coalesce(supported / claims >= 0.3, false) AS passed FROM reports r LEFT JOIN f ON f.doc_id = r.doc_id""".replace("{html}", _HTML))  # fmt: skip
def quote_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("url", text.html_text(F.col("html")).alias("body"))
    return verifiers.quote_match(views.reports(spark, sf_dir), pages, list(HOSTS))


@query("perspective")
def perspective(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every report's third-level headings, and two words that documents have, as the things it assesses."""
    reports = views.reports(spark, sf_dir)
    listed = reports.select("doc_id", F.explode(F.array(F.lit("Report"), F.lit("the"))).alias("entity")).where("doc_id % 3 != 0")
    return verifiers.perspective(reports, verifiers.heading_entities(reports).union(listed))


_HITS = lambda patterns: " + ".join(f"CAST(regexp_matches(text, '(?i){p}') AS INT)" for p in patterns)


@query("refusal_verdicts", rf"""WITH n AS (SELECT conv_id, turn, regexp_matches(lower(text), 'https?://[^\s)]*the-lost-book') AS linked, CAST(regexp_matches(text, '(?i)launched in \d+') AS INT) AS red_flags, {_HITS(text.REFUSALS)} AS refusals, {_HITS(text.HEDGES)} AS hedges, {_TOKENS('text')} AS words FROM conversations),
v AS (SELECT *, CASE WHEN linked THEN 'HALLUCINATION_URL' WHEN red_flags > 0 THEN 'HALLUCINATION_CLAIMS' WHEN refusals >= 2 OR (refusals >= 1 AND hedges >= 1) THEN 'REFUSAL' WHEN hedges >= 3 THEN 'PARTIAL_HEDGE' ELSE 'AMBIGUOUS' END AS verdict FROM n)
SELECT verdict, count(*) AS n, sum(words)::BIGINT AS words, sum(refusals)::BIGINT AS refusals, sum(hedges)::BIGINT AS hedges FROM v GROUP BY 1""")
def refusal_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("doc_id"), F.col("text").alias("md"))
    judged = verifiers.refusals(turns, ["The Lost Book"], [r"launched in \d+"])
    return judged.groupBy("verdict").agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in ("words", "refusals", "hedges")))


@query("triple_recall", """WITH t AS (SELECT doc_id, lang AS subject, source AS object, trim(regexp_replace(lower(text || ' ' || lang), '\\s+', ' ', 'g')) AS body FROM documents) SELECT doc_id, count(*) AS triples, count(*) FILTER (contains(body, subject) AND contains(body, object)) AS hits, round(count(*) FILTER (contains(body, subject) AND contains(body, object)) / count(*), 6) AS recall FROM t GROUP BY 1""")
def triple_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    triples = docs.select("doc_id", F.col("lang").alias("subject"), F.col("source").alias("object"))
    return verifiers.triple_recall(triples, docs.select("doc_id", F.concat_ws(" ", "text", "lang").alias("md")))


@query("numbers_in_names", "SELECT p_partkey, try_cast(nullif(regexp_extract(regexp_replace(p_name, '(\\d),(\\d)', '\\1\\2', 'g'), '(-?\\d+(?:\\.\\d+)?)', 1), '') AS DOUBLE) AS number, abs(p_retailprice - 1000) / greatest(p_retailprice, 1000) <= 0.05 AS near_1000 FROM part")
def numbers_in_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", numeric.first_number(F.col("p_name")).alias("number"), numeric.close(F.col("p_retailprice"), F.lit(1000.0), 0.05).alias("near_1000"))


@query("grades", "WITH s AS (SELECT event_id, value / 100 AS s FROM events) SELECT CASE WHEN s >= 0.95 THEN 'A+' WHEN s >= 0.9 THEN 'A' WHEN s >= 0.85 THEN 'B+' WHEN s >= 0.8 THEN 'B' WHEN s >= 0.7 THEN 'C' WHEN s >= 0.6 THEN 'D' ELSE 'F' END AS grade, count(*) AS n FROM s GROUP BY 1")
def grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(numeric.grade(F.col("value") / 100).alias("grade")).agg(F.count("*").alias("n"))


@query("claim_search", """WITH q AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{3,}')) AS w FROM benchmark WHERE item_id % 20 = 0), d AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{3,}')) AS w FROM documents),
s AS (SELECT item_id, doc_id, len(list_intersect(q.w, d.w)) / len(q.w) AS s FROM q, d WHERE len(q.w) > 0) SELECT item_id, doc_id, round(s, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY s DESC, doc_id) AS r FROM s) WHERE r <= 3""")  # fmt: skip
def claim_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three documents that hold most of each stated query's words, in blocks of queries and documents."""
    from scorewright.operators.aggregates import best_by_words

    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]{3,}"), F.lit(0)))
    asked = table(spark, sf_dir, "benchmark").where("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), words(F.col("text")).alias("words")).where(F.size("words") > 0)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), words(F.coalesce("text", F.lit(""))).alias("words"))
    return best_by_words(asked, docs, 3).select(F.col("query_id").alias("item_id"), F.col("row_id").alias("doc_id"), F.round("score", 6).alias("score"))
