"""Verifiers of reports: a row for every report, with score, passed and what they rest on.

Reports are (id, md) or, where a task's lists are asked for, (id, task, md); ids are unique. Pages, statuses and
judgements of models are tables. Null and empty reports are reports without words or citations; they get the row that
the docstrings state. Nothing is looked up in part: all URLs and claims of a report count.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorewright.functions import numeric, text, url
from scorewright.operators.citations import citations, has_citation
from scorewright.storage import materialised

#: Hosts that count as the sandbox, and what kind of source each is, unless others are given.
HOSTS = {"localhost:7770": "shopping", "localhost:9999": "reddit", "localhost:8090": "wiki"}


def _share(part: Column | str, whole: Column | str, otherwise: float = 0.0) -> Column:
    part, whole = (F.col(c) if isinstance(c, str) else c for c in (part, whole))
    return F.coalesce(part / F.nullif(whole, F.lit(0)), F.lit(otherwise))


def _rounded(score: Column, places: int = 4) -> Column:
    return F.round(score, places)


def _per_report(reports: DataFrame, counted: DataFrame, id_column: str, counts: list[str]) -> DataFrame:
    """Every report's counts, zero where it has none."""
    return reports.select(id_column).join(counted, id_column, "left").fillna(0, subset=counts)


def degenerate(reports: DataFrame, min_words: int = 50, require_citations: bool = True, id_column: str = "doc_id", md_column: str = "md") -> DataFrame:
    """(id, degenerate, reason): whether a report is none, and why: empty, a runner's placeholder, too few words, no citation."""
    md = F.col(md_column)
    reason = text.degenerate(md, has_citation(md).cast("int") if require_citations else None, min_words)
    return reports.select(id_column, F.coalesce(reason, F.lit("")).alias("reason")).select(id_column, (F.col("reason") != "").alias("degenerate"), "reason")


def markdown_contract(reports: DataFrame, min_words: int = 0, max_words: int | None = None, min_paragraphs: int = 0, min_citations: int = 0, min_pages: int = 0, domains: tuple[str, ...] = (), pages_browsed: str | None = None, id_column: str = "doc_id", md_column: str = "md") -> DataFrame:
    """Five checks of a report's form and their mean; passed if all hold.

    Words, paragraphs, markdown links (to `domains`, if any are given) and pages browsed (a column; a null, or no
    column, is no reason to fail) hold or don't; words above the most lose credit, up to a fifth over.
    """
    body = F.coalesce(F.col(md_column), F.lit(""))
    inside = lambda u: reduce(lambda a, d: a | F.contains(F.lower(u), F.lit(d.lower())), domains, F.lit(not domains))
    counts = {"words": text.words(body), "paragraphs": F.size(text.blocks(body)), "citations": F.size(F.filter(text.links(body), inside)), "pages": F.col(pages_browsed) if pages_browsed else F.lit(None).cast("int")}
    out = reports.select(id_column, *(c.cast("long").alias(n) for n, c in counts.items()))
    over = F.lit(1.0) if not max_words else F.when(F.col("words") <= max_words, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - (F.col("words") - max_words) / max_words / 0.2))
    least = lambda name, n: (F.col(name) >= n).cast("double")
    out = out.withColumns({"enough_words": least("words", min_words), "not_too_many": over, "enough_paragraphs": least("paragraphs", min_paragraphs), "enough_citations": least("citations", min_citations), "enough_pages": F.coalesce(least("pages", min_pages), F.lit(1.0))})
    checks = [F.col(c) for c in ("enough_words", "not_too_many", "enough_paragraphs", "enough_citations", "enough_pages")]
    return out.withColumns({"score": _rounded(reduce(lambda a, c: a + c, checks) / 5, 3), "passed": reduce(lambda a, c: a & (c >= 0.999), checks, F.lit(True)), "not_too_many": _rounded(over, 3)})


def url_coverage(reports: DataFrame, must: DataFrame, pool: DataFrame, domains: dict[str, tuple[list[str], int]] | None = None, min_recall: float = 0.45, min_pool: float = 0.12, min_urls: int = 60, min_balance: float = 0.80, weights: tuple[float, float, float] = (0.55, 0.15, 0.30), id_column: str = "doc_id", task_column: str = "task", md_column: str = "md") -> DataFrame:
    """How far a report's distinct URLs cover its task's: must (task, url, weight) and pool (task, url), joined by task and canonical URL.

    domains: {name: (hosts, least number of URLs)}; balance is the least share of these numbers, 1.0 if there are none.
    A report of a task without must URLs fails with score 0.0; one without citations has zeros.
    """
    own = reports.select(id_column, task_column)
    must = must.select(task_column, url.canonical(F.col("url")).alias("url"), "weight").groupBy(task_column, "url").agg(F.max("weight").alias("weight"))
    pool = pool.select(task_column, url.canonical(F.col("url")).alias("url")).distinct().withColumn("pooled", F.lit(1))
    of_task = must.groupBy(task_column).agg(F.sum("weight").alias("total_weight"), F.count("*").alias("must_total")).join(pool.groupBy(task_column).agg(F.count("*").alias("pool_total")), task_column, "full").fillna(0)
    cited = citations(reports, None, id_column, md_column, ("url",), (task_column,)).distinct()
    reach = {name: url.host_in(F.col("url"), hosts) for name, (hosts, _) in (domains or {}).items()}
    counted = cited.join(must, [task_column, "url"], "left").join(pool, [task_column, "url"], "left").groupBy(id_column).agg(
        F.count("*").alias("cited"), F.count("weight").alias("must_hit"), F.sum("weight").alias("hit_weight"), F.count("pooled").alias("pool_hit"), *(F.count_if(c).alias(f"cited_{n}") for n, c in reach.items())
    )
    out = own.join(counted, id_column, "left").join(of_task, task_column, "left").fillna(0)
    recall, share = _share("hit_weight", "total_weight"), _share("pool_hit", "pool_total")
    fills = [F.least(F.lit(1.0), F.col(f"cited_{n}") / least) for n, (_, least) in (domains or {}).items() if least > 0]
    balance = F.lit(1.0) if not fills else fills[0] if len(fills) == 1 else F.least(*fills)
    score = F.when(F.col("must_total") == 0, 0.0).otherwise(weights[0] * recall + weights[1] * share + weights[2] * balance)
    passed = (F.col("must_total") > 0) & (recall >= min_recall) & (share >= min_pool) & (balance >= min_balance) & (F.col("cited") >= min_urls)
    return out.select(id_column, "cited", "must_total", "must_hit", _rounded(recall).alias("must_recall"), "pool_total", "pool_hit", _rounded(share).alias("pool_share"), *(f"cited_{n}" for n in reach), _rounded(balance).alias("domain_balance"), _rounded(score + 1e-9).alias("score"), passed.alias("passed"))


def url_reachability(reports: DataFrame, status: DataFrame, hosts: list[str] | None = None, min_rate: float = 0.30, id_column: str = "doc_id", md_column: str = "md") -> DataFrame:
    """Which of a report's distinct URLs on `hosts` can be reached: status (url, code), by canonical URL; no or a null code is a failed connection.

    Server errors and failed connections leave the denominator; if nothing else is left the infrastructure failed. A
    report without URLs on these hosts fails with score 0.0.
    """
    hosts = list(HOSTS) if hosts is None else hosts
    known = status.select(url.canonical(F.col("url")).alias("url"), F.col("code").cast("int").alias("code")).groupBy("url").agg(F.max("code").alias("code"))
    cited = citations(reports, None, id_column, md_column, ("url",)).distinct().withColumn("inside", url.host_in(F.col("url"), hosts))
    code, inside = F.coalesce("code", F.lit(0)), F.col("inside")
    bad = code.isin(400, 401, 403, 404, 410)
    names = ["cited", "cited_inside", "ok", "broken", "server", "none"]
    counted = cited.join(known, "url", "left").groupBy(id_column).agg(F.count("*").alias("cited"), F.count_if(inside).alias("cited_inside"), F.count_if(inside & (code == 200)).alias("ok"), F.count_if(inside & bad).alias("broken"), F.count_if(inside & code.between(500, 599)).alias("server"), F.count_if(inside & (code == 0)).alias("none"))
    out = _per_report(reports, counted, id_column, names)
    usable, lost = F.col("cited_inside") - F.col("server") - F.col("none"), F.col("server") + F.col("none")
    rate, failed = _share("ok", usable), (F.col("cited_inside") > 0) & (usable == 0)
    return out.select(id_column, *names, _rounded(rate).alias("score"), ((F.col("cited_inside") > 0) & (rate >= min_rate) & ~failed).alias("passed"), failed.alias("infra_failure"), ((F.col("cited_inside") > 0) & (lost >= 0.3 * F.col("cited_inside"))).alias("infra_warning"))


def _one_body(pages: DataFrame) -> DataFrame:
    """(url, body): of several bodies of a URL the least one counts, so that it does not hang on partitions."""
    return pages.groupBy("url").agg(F.min("body").alias("body"))


def quote_match(reports: DataFrame, pages: DataFrame, hosts: list[str] | None = None, floor: float = 0.10, min_rate: float = 0.30, id_column: str = "doc_id", md_column: str = "md") -> DataFrame:
    """How many of a report's citations on `hosts` have a claim whose words the page, pages (url, body) by the URL as written, holds to `floor` or more.

    Only words travel. Claims without a page are unreachable, claims without words not supported; a report without
    citations fails with score 0.0.
    """
    hosts = list(HOSTS) if hosts is None else hosts
    claims = citations(reports, hosts, id_column, md_column, ("raw_url", "claim")).select(id_column, F.col("raw_url").alias("url"), text.content_words(F.col("claim")).alias("claim_words"))
    words = _one_body(pages.join(claims.select("url").distinct(), "url", "left_semi")).select("url", text.content_words(F.col("body")).alias("page_words"))
    held = F.coalesce(text.containment(F.col("claim_words"), F.col("page_words")) >= floor, F.lit(False))
    counted = claims.join(words, "url", "left").groupBy(id_column).agg(F.count("*").alias("claims"), F.count_if(held).alias("supported"), F.count_if(F.col("page_words").isNull()).alias("unreachable"))
    rate = _share("supported", "claims")
    return _per_report(reports, counted, id_column, ["claims", "supported", "unreachable"]).select(id_column, "claims", "supported", "unreachable", _rounded(rate).alias("score"), ((F.col("claims") > 0) & (rate >= min_rate)).alias("passed"))


def claim_support(reports: DataFrame, quotes: DataFrame, judged: DataFrame, hosts: list[str] | None = None, theta: float = 0.80, min_rate: float = 0.50, id_column: str = "doc_id", task_column: str = "task", md_column: str = "md") -> DataFrame:
    """Claims on URLs that the task's quotes (task, url, quote) are from, and how many of them a judge holds to follow from the quote.

    judged: (url, claim_hash, prob), the judge's probability for a claim by xxhash64 of its text; none is 0.0. The
    strict rate counts `theta` or more, the soft one more than 0.5. A report without such claims fails with score 0.0.
    """
    hosts = list(HOSTS) if hosts is None else hosts
    known = quotes.where("quote is not null and quote != ''").select(task_column, url.canonical(F.col("url")).alias("url")).distinct()
    claims = citations(reports, hosts, id_column, md_column, ("url", "claim"), (task_column,)).select(id_column, task_column, "url", F.xxhash64("claim").alias("claim_hash")).join(known, [task_column, "url"], "left_semi")
    prob = F.coalesce("prob", F.lit(0.0))
    best = judged.select(url.canonical(F.col("url")).alias("url"), "claim_hash", "prob").groupBy("url", "claim_hash").agg(F.max("prob").alias("prob"))
    counted = claims.join(best, ["url", "claim_hash"], "left").groupBy(id_column).agg(F.count("*").alias("claims"), F.count_if(prob >= theta).alias("above"), F.count_if(prob > 0.5).alias("entailed"))
    strict, soft = _share("above", "claims"), _share("entailed", "claims")
    return _per_report(reports, counted, id_column, ["claims", "above", "entailed"]).select(id_column, "claims", "above", "entailed", _rounded(soft).alias("soft_rate"), _rounded(strict).alias("score"), ((F.col("claims") > 0) & (strict >= min_rate)).alias("passed"))


def cited_sentences(reports: DataFrame, hosts: list[str] | None = None, id_column: str = "doc_id", md_column: str = "md") -> DataFrame:
    """(id, sentence_at, sentence, url) for each URL on `hosts` in each sentence, once for the first 80 characters of a sentence and a URL."""
    hosts = list(HOSTS) if hosts is None else hosts
    parts = reports.select(id_column, F.posexplode(F.split(F.coalesce(F.col(md_column), F.lit("")), r"(?U)(?<=[.!?])\s+|\n{2,}|\n(?=[-*] )")).alias("sentence_at", "raw"))
    clean = F.left(text.strip(F.regexp_replace(F.col("raw"), r"(?U)\[([^\]]{1,200})\]\(https?://[^)\s]{1,800}\)", "$1")), F.lit(600))
    rows = parts.select(id_column, "sentence_at", clean.alias("sentence"), F.explode(F.filter(text.urls(F.col("raw")), lambda u: url.host_in(u, hosts))).alias("url"))
    first = rows.groupBy(id_column, F.left("sentence", F.lit(80)).alias("head"), "url").agg(F.min(F.struct("sentence_at", "sentence")).alias("s"))
    return first.select(id_column, "s.sentence_at", "s.sentence", "url")


def citation_alignment(reports: DataFrame, judged: DataFrame, hosts: list[str] | None = None, min_precision: float = 0.50, id_column: str = "doc_id", md_column: str = "md") -> DataFrame:
    """Of a report's pairs of sentence and URL those that a judge supports, judged (url, sentence_hash, supported); a pair not judged could not be fetched.

    Precision is over pairs (the score), recall over sentences with a citation. Without pairs both are 0.0.
    """
    pairs = cited_sentences(reports, hosts, id_column, md_column).withColumn("sentence_hash", F.xxhash64("sentence"))
    best = judged.groupBy("url", "sentence_hash").agg(F.max(F.col("supported").cast("boolean")).alias("supported"))
    hit = F.coalesce("supported", F.lit(False))
    counted = pairs.join(best, ["url", "sentence_hash"], "left").groupBy(id_column).agg(F.count("*").alias("pairs"), F.count_if(hit).alias("supported_pairs"), F.count_if(F.col("supported").isNull()).alias("fetch_failures"), F.count_distinct("sentence_at").alias("sentences"), F.count_distinct(F.when(hit, F.col("sentence_at"))).alias("supported_sentences"))
    names = ["pairs", "supported_pairs", "fetch_failures", "sentences", "supported_sentences"]
    precision, recall = _share("supported_pairs", "pairs"), _share("supported_sentences", "sentences")
    return _per_report(reports, counted, id_column, names).select(id_column, *names, _rounded(recall).alias("recall"), _rounded(precision).alias("score"), ((F.col("pairs") > 0) & (precision >= min_precision)).alias("passed"))


def source_diversity(reports: DataFrame, hosts: dict[str, str] | None = None, least: dict[str, int] | None = None, min_subforums: int = 3, min_score: float = 0.50, id_column: str = "doc_id", md_column: str = "md") -> DataFrame:
    """Spread of a report's citations on `hosts` ({host:port: kind}): entropy over hosts, share of the first, kinds filled, subforums.

    least: citations that each kind should have. All citations count, repeated ones too; without any the score is 0.0.
    """
    # Citations of each kind that are asked for unless `least` says otherwise.
    hosts, least = HOSTS if hosts is None else hosts, {"shopping": 20, "reddit": 15, "wiki": 10} | (least or {})
    cited = citations(reports, None, id_column, md_column, ("raw_url",)).withColumn("host", url.host_port(F.col("raw_url")))
    kind = reduce(lambda out, h: F.when(F.col("host") == h[0], h[1]).otherwise(out), hosts.items(), F.lit("other"))
    subforum = F.nullif(F.lower(F.regexp_extract("raw_url", r"/f/([A-Za-z0-9_\-]+)/", 1)), F.lit(""))
    # Whether a URL is inside hangs on its host and port, so texts are gone through once.
    per_host = cited.groupBy(id_column, "host").agg(F.count("*").alias("n"), F.bool_or(url.host_in(F.col("raw_url"), list(hosts))).alias("inside"), F.collect_set(subforum).alias("forums")).withColumn("kind", kind)
    inside, n = F.col("inside"), F.when(F.col("inside"), F.col("n"))
    total = per_host.groupBy(id_column).agg(
        F.sum("n").alias("citations"), F.coalesce(F.sum(n), F.lit(0)).alias("inside"), F.size(F.array_distinct(F.flatten(F.collect_list(F.when(inside, F.col("forums")))))).cast("long").alias("subforums"),
        F.count_if(inside).alias("hosts"), F.sort_array(F.collect_list(n.cast("double"))).alias("counts"), (F.max(n) / F.sum(n)).alias("top"), *(F.coalesce(F.sum(F.when(F.col("kind") == k, n)), F.lit(0)).alias(f"of_{k}") for k in least),
    )
    out = _per_report(reports, total, id_column, ["citations", "inside", "subforums", "hosts", "top", *(f"of_{k}" for k in least)])
    entropy, top = F.coalesce(numeric.entropy(F.col("counts")), F.lit(0.0)), numeric.share_score(F.col("top"))
    balance = F.least(*(F.least(F.lit(1.0), F.col(f"of_{k}") / max(1, n)) for k, n in least.items()))
    forums = F.least(F.lit(1.0), F.col("subforums") / max(1, min_subforums))
    score = F.when(F.col("inside") == 0, 0.0).otherwise(0.35 * entropy + 0.25 * top + 0.25 * balance + 0.15 * forums)
    shown = {"entropy": entropy, "top_share": F.col("top"), "top_score": F.when(F.col("inside") == 0, 0.0).otherwise(top), "type_balance": balance, "subforum_diversity": forums}
    return out.select(id_column, "citations", "inside", "hosts", "subforums", *(_rounded(c).alias(n) for n, c in shown.items()), _rounded(score + 1e-9).alias("score"), ((F.col("inside") > 0) & (score >= min_score)).alias("passed"))


def _graded(out: DataFrame, id_column: str, shown: list[str], checks: list[Column], judged: DataFrame | None, min_score: float) -> DataFrame:
    """Share of the checks that hold; with a judge's share (id, tier_b), four tenths of the one and six of the other."""
    tier_a = reduce(lambda a, c: a + c.cast("int"), checks, F.lit(0)) / len(checks)
    if judged is None:
        return out.select(id_column, *shown, _rounded(tier_a).alias("score"), (tier_a >= min_score).alias("passed"))
    score = 0.4 * tier_a + 0.6 * F.coalesce("tier_b", F.lit(0.0))
    return out.join(judged.select(id_column, "tier_b"), id_column, "left").select(id_column, *shown, _rounded(tier_a).alias("tier_a"), "tier_b", _rounded(score).alias("score"), (score >= min_score).alias("passed"))


def analysis_depth(reports: DataFrame, judged: DataFrame | None = None, min_score: float = 0.5, id_column: str = "doc_id", md_column: str = "md") -> DataFrame:
    """Four checks over paragraphs of more than 20 characters: one cites two domains, three contradict, three rest on three URLs of two domains, and 0.15 compare.

    An empty report has no paragraphs, so it meets none.
    """
    body = F.coalesce(F.col(md_column), F.lit(""))

    def measured(p: Column) -> Column:
        domains = lambda urls: F.size(F.filter(F.array_distinct(F.transform(urls, url.domain)), lambda d: d != ""))
        linked = lambda urls: F.struct(F.size(urls).alias("urls"), domains(urls).alias("domains"))
        return F.struct(F.when(p.contains("http"), text.let(text.urls(p), linked)).alias("links"), p.rlike(text.CONTRADICTION).alias("against"), p.rlike(text.COMPARATIVE).alias("compares"))

    out = reports.select(id_column, F.transform(text.paragraphs(body), measured).alias("p"))
    count = lambda holds: F.size(F.filter("p", holds)).cast("long")
    several = lambda x: F.coalesce(x["links"]["domains"] >= 2, F.lit(False))
    out = out.select(id_column, F.size("p").cast("long").alias("paragraphs"), count(several).alias("cross_source"), count(lambda x: x["against"]).alias("contradictions"), count(lambda x: several(x) & (x["links"]["urls"] >= 3)).alias("chains"), count(lambda x: x["compares"]).alias("compares"))
    out = out.withColumn("density", _rounded(_share("compares", "paragraphs"), 3))
    checks = [F.col("cross_source") >= 1, F.col("contradictions") >= 3, F.col("chains") >= 3, F.col("density") >= 0.15]
    return _graded(out, id_column, ["paragraphs", "cross_source", "contradictions", "chains", "density"], checks, judged, min_score)


def presentation(reports: DataFrame, judged: DataFrame | None = None, min_score: float = 0.5, id_column: str = "doc_id", md_column: str = "md") -> DataFrame:
    """Six checks of form: three heading depths, five sections, their evenness, a list or table, no long text before the first heading, reading ease of 30.

    Text before the first second-level heading is a section too. An empty report has no sections, so its evenness fails.
    """
    body = F.coalesce(F.col(md_column), F.lit(""))
    orphan = (text.tokens(F.get(F.split(body, r"(?mdU)^#{1,6}\s+.*$"), F.lit(0))) > 200).cast("int")
    out = reports.select(id_column, text.heading_levels(body).alias("levels"), F.transform(text.sections(body), lambda s: text.tokens(s).cast("double")).alias("sizes"), text.has_list_or_table(body).alias("listed"), orphan.alias("orphans"), F.round(text.reading_ease(body), 1).alias("ease"))
    out = out.withColumns({"sections": F.size("sizes"), "variation": F.round(text.variation(F.col("sizes")), 3)})
    checks = [F.col("levels") >= 3, F.col("sections") >= 5, (F.col("variation") < 1.5) & (F.col("sections") > 0), F.col("listed"), F.col("orphans") == 0, F.col("ease") >= 30]
    return _graded(out, id_column, ["levels", "sections", "variation", "listed", "orphans", "ease"], checks, judged, min_score)


def heading_entities(reports: DataFrame, most: int = 12, id_column: str = "doc_id", md_column: str = "md") -> DataFrame:
    """(id, entity): things that third-level headings name, usual section names aside, without ranks before them; the first `most` of a report."""
    # Headings that name no thing.
    usual = r"(?iU)^(introduction|conclusion|references|methodology|background|overview|summary|appendix|outline|findings|results|discussion|part [a-z\d]+|section [a-z\d]+|product landscape|community sentiment|technical context|technical foundation|cross-source synthesis|buying guide|recommendations?|comparison)"
    titles = F.filter(F.transform(F.regexp_extract_all(F.coalesce(F.col(md_column), F.lit("")), F.lit(r"(?mdU)^###\s+(.+?)\s*$"), F.lit(1)), text.strip), lambda t: (t != "") & ~t.rlike(usual))
    bare = lambda t: F.btrim(text.strip(F.regexp_replace(F.regexp_replace(t, r"(?U)^[(\[]?\d+[)\].:\-]?\s*", ""), r"(?iU)^top\s*\d+\s*[:\-]?\s*", "")), F.lit("-:"))
    named = F.filter(F.transform(titles, bare), lambda t: F.char_length(t).between(3, 80))
    first = F.filter(named, lambda t, i: ~F.array_contains(F.transform(F.slice(named, 1, i), F.lower), F.lower(t)))
    return reports.select(id_column, F.explode(F.slice(first, 1, most)).alias("entity"))


def perspective(reports: DataFrame, entities: DataFrame, judged: DataFrame | None = None, around: int = 100, min_score: float = 0.5, id_column: str = "doc_id", md_column: str = "md") -> DataFrame:
    """Whether each thing that a report assesses, entities (id, entity), is found fault with: of the words around its mentions, one disapproves at least, and at most five times as many approve.

    judged: (id, entity, specific), whether a judge found a specific fault. The score is the share of entities that
    pass, or four tenths of it and six of the judge's. Reports without entities are not concerned: 1.0.
    """
    rows = entities.where("entity is not null and trim(entity) != ''").distinct().join(reports.select(id_column, F.coalesce(F.col(md_column), F.lit("")).alias("_body")), id_column)
    pattern = F.concat(F.lit(r"(?iU)\b\Q"), F.col("entity"), F.lit(r"\E\b"))
    near = F.array_join(F.transform(text.found(F.col("_body"), pattern), lambda m: text.window(F.col("_body"), m["at"], m["at"] + F.char_length(m["hit"]), around)), " ")
    each = rows.select(id_column, "entity", near.alias("near")).withColumn("n", text.lexicon_counts(F.col("near")))
    fair = (F.col("n.negative") >= 1) & (F.col("n.positive") <= 5 * F.col("n.negative"))
    each = each.select(id_column, "entity", (F.col("near") != "").alias("mentioned"), F.col("n.positive").alias("positive"), F.col("n.negative").alias("negative"), fair.alias("balanced"))
    specific = F.lit(False)
    if judged is not None:
        each = each.join(judged.select(id_column, "entity", "specific").distinct(), [id_column, "entity"], "left")
        specific = F.coalesce("specific", F.lit(False))
    names = ["entities", "mentioned", "positive", "negative", "balanced", "specific"]
    counted = each.groupBy(id_column).agg(F.count("*").alias("entities"), F.count_if("mentioned").alias("mentioned"), F.sum("positive").alias("positive"), F.sum("negative").alias("negative"), F.count_if("balanced").alias("balanced"), F.count_if(specific).alias("specific"))
    tier_a, tier_b = _share("balanced", "entities", 1.0), _share("specific", "entities", 1.0)
    score = tier_a if judged is None else 0.4 * tier_a + 0.6 * tier_b
    return _per_report(reports, counted, id_column, names).select(id_column, *(names if judged is not None else names[:-1]), _rounded(score).alias("score"), (score >= min_score).alias("passed"))


def refusals(reports: DataFrame, fake: list[str] = (), red_flags: list[str] = (), id_column: str = "doc_id", md_column: str = "md") -> DataFrame:
    """What a report on things that don't exist amounts to: verdict and score, links to them or claims on them first, then refusal, hedging, neither.

    fake: names of such things; red_flags: patterns of claims on them. An empty report is ambiguous.
    """
    body = F.coalesce(F.col(md_column), F.lit(""))
    slugs = [name.lower().replace(" ", "-").replace("'", "") for name in fake]
    links = F.regexp_extract_all(body, F.lit(r"(?U)https?://[^\s)]+"), F.lit(0))
    linked = F.exists(links, lambda u: reduce(lambda a, s: a | F.contains(F.lower(u), F.lit(s)), slugs, F.lit(False)))
    out = reports.select(id_column, linked.alias("linked"), text.phrase_hits(body, list(red_flags)).alias("red_flags"), text.phrase_hits(body, text.REFUSALS).alias("refusals"), text.phrase_hits(body, text.HEDGES).alias("hedges"), text.tokens(body).alias("words"))
    refused = (F.col("refusals") >= 2) | (F.col("refusals") >= 1) & (F.col("hedges") >= 1)
    verdict = F.when(F.col("linked"), "HALLUCINATION_URL").when(F.col("red_flags") > 0, "HALLUCINATION_CLAIMS").when(refused, "REFUSAL").when(F.col("hedges") >= 3, "PARTIAL_HEDGE").otherwise("AMBIGUOUS")
    score = F.when(F.col("verdict") == "REFUSAL", 1.0).when(F.col("verdict") == "PARTIAL_HEDGE", 0.5).when(F.col("verdict") == "AMBIGUOUS", 0.3).otherwise(0.0)
    return out.withColumn("verdict", verdict).select(id_column, "linked", "red_flags", "refusals", "hedges", "words", "verdict", score.alias("score"), (F.col("verdict") == "REFUSAL").alias("passed"))


def compliance(reports: DataFrame, hosts: list[str] | None = None, id_column: str = "doc_id", md_column: str = "md") -> DataFrame:
    """Share of a report's distinct URLs that are on `hosts` (all hosts of the sandbox, under either name of this machine, unless given); 1.0 without any.

    Of the ways a URL is written the first one counts.
    """
    hosts = [f"{h}:{p}" for h in ("localhost", "127.0.0.1") for p in (7770, 9999, 8090, 8081)] if hosts is None else hosts
    first = citations(reports, None, id_column, md_column, ("at", "raw_url", "url")).groupBy(id_column, "url").agg(F.min_by("raw_url", "at").alias("raw_url"))
    counted = first.groupBy(id_column).agg(F.count("*").alias("urls"), F.count_if(url.host_in(F.col("raw_url"), hosts)).alias("allowed"))
    share = _share("allowed", "urls", 1.0)
    return _per_report(reports, counted, id_column, ["urls", "allowed"]).select(id_column, "urls", "allowed", F.round(share, 6).alias("score"), (share == 1.0).alias("passed"))


def triple_recall(triples: DataFrame, reports: DataFrame, id_column: str = "doc_id", md_column: str = "md") -> DataFrame:
    """(id, triples, hits, recall): facts (id, subject, object) whose both ends a report mentions, white space and case aside."""
    plain = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    met = triples.join(reports.select(id_column, plain(F.col(md_column)).alias("body")), id_column)
    hit = F.contains(F.col("body"), plain(F.col("subject"))) & F.contains(F.col("body"), plain(F.col("object")))
    return met.groupBy(id_column).agg(F.count("*").alias("triples"), F.count_if(hit).alias("hits")).withColumn("recall", F.round(F.col("hits") / F.col("triples"), 6))


def contamination(reports: DataFrame, facts: DataFrame, around: int = 600, min_score: float = 0.50, id_column: str = "doc_id", md_column: str = "md", block: int = 10_000) -> DataFrame:
    """Whether a report gives planted values or those known before: facts (topic, prior_value, sandbox_value), asked of every report.

    A value counts within `around` characters of the topic, or anywhere where the topic isn't named. The score is the
    share of facts whose topic is named that have the planted value, those with both counting half; 0.0 without any.
    Facts are usually few, a list of planted changes: they are broadcast, in blocks of about `block` where there are
    more. A report's text is searched for places only for topics that it contains.
    """
    facts = facts.select("topic", "prior_value", "sandbox_value")
    blocks = max(1, -(-facts.count() // block))
    low = lambda c: F.regexp_replace(F.lower(c), r"(?U)\s+", " ")
    told = reports.select(id_column, F.coalesce(F.col(md_column), F.lit("")).alias("body")).withColumn("low", low(F.col("body")))
    known = facts.fillna("").withColumn("mark", low(F.col("topic"))).withColumn("_block", F.pmod(F.xxhash64("topic", "prior_value", "sandbox_value"), F.lit(blocks)))
    rows = reduce(DataFrame.unionByName, (told.join(F.broadcast(known.where(F.col("_block") == i).drop("_block"))) for i in range(blocks)))
    spots = F.when((F.col("mark") == "") | ~F.contains("low", F.col("mark")), F.array().cast("array<string>")).otherwise(F.transform(text.found(F.col("low"), F.concat(F.lit(r"\Q"), F.col("mark"), F.lit(r"\E"))), lambda m: text.window(F.col("body"), m["at"], m["at"] + F.char_length("topic"), around)))
    rows = rows.withColumn("spots", spots).withColumn("named", F.size("spots") > 0).withColumn("spots", F.when(F.col("named"), F.col("spots")).otherwise(F.array("body")))
    near = lambda value: (F.trim(value) != "") & F.exists("spots", lambda s: F.contains(low(s), low(F.trim(F.col(value) if isinstance(value, str) else value))))
    rows = rows.select(id_column, "topic", "named", near(F.col("prior_value")).alias("prior"), near(F.col("sandbox_value")).alias("planted"))
    verdict = F.when(F.col("planted") & ~F.col("prior"), "sandbox").when(F.col("prior") & ~F.col("planted"), "prior").when(F.col("prior"), "both").when(F.col("named"), "neither").otherwise("topic_not_referenced")
    rows = rows.withColumn("verdict", verdict)
    kinds = ["sandbox", "prior", "both", "neither", "topic_not_referenced"]
    counted = rows.groupBy(id_column).agg(F.count("*").alias("facts"), *(F.count_if(F.col("verdict") == k).alias(k) for k in kinds))
    score = _share(F.col("sandbox") + 0.5 * F.col("both"), F.col("facts") - F.col("topic_not_referenced"))
    return _per_report(reports, counted, id_column, ["facts", *kinds]).select(id_column, "facts", *kinds, _rounded(score).alias("score"), ((F.col("facts") > 0) & (score >= min_score)).alias("passed"))


def factual_exactness(facts: DataFrame, pages: DataFrame, reports: DataFrame, judged: DataFrame | None = None, hosts: list[str] | None = None, min_score: float = 0.50, id_column: str = "doc_id", md_column: str = "md") -> DataFrame:
    """Of the facts taken from a report, (id, url, value, value_type), those on `hosts` whose value their page (url, body) has.

    What the page doesn't have by rule a judge may still hold true: judged (id, url, value, supported). Facts without
    a page are unfetchable and don't count as supported. A degenerate report, or one without facts, fails with 0.0.
    """
    hosts = list(HOSTS) if hosts is None else hosts
    own = facts.where("value is not null and value != ''").where(url.host_in(F.col("url"), hosts)).withColumn("value_type", F.coalesce("value_type", F.lit("")))
    # A value is looked for once in a page, however many reports give it; what comes back is two flags, not the page.
    asked = own.select("url", "value", "value_type").distinct().join(_one_body(pages), "url", "left")
    told = asked.select("url", "value", "value_type", F.coalesce(numeric.value_in_page(F.col("value"), F.lower(F.trim("value_type")), F.col("body")), F.lit(False)).alias("found"), F.col("body").isNotNull().alias("there"), (F.coalesce("body", F.lit("")) == "").alias("bare"))
    met = own.join(told, ["url", "value", "value_type"])
    found = F.col("found")
    held = F.lit(False)
    if judged is not None:
        met = met.join(judged.select(id_column, "url", "value", F.col("supported").alias("_judged")).distinct(), [id_column, "url", "value"], "left")
        held = ~found & F.col("there") & F.coalesce("_judged", F.lit(False))
    counted = met.groupBy(id_column).agg(F.count("*").alias("facts"), F.count_if(found).alias("by_rule"), F.count_if(held).alias("by_judge"), F.count_if("bare").alias("unfetchable"))
    names = ["facts", "by_rule", "by_judge", "unfetchable"]
    out = _per_report(reports, counted, id_column, names).join(degenerate(reports, 50, True, id_column, md_column), id_column)
    score = F.when(F.col("degenerate"), 0.0).otherwise(_share(F.col("by_rule") + F.col("by_judge"), "facts"))
    return out.select(id_column, *names, "degenerate", _rounded(score).alias("score"), ((F.col("facts") > 0) & (score >= min_score)).alias("passed"))


def consistency_pairs(reports: DataFrame, per_cluster: int = 12, in_all: int = 60, id_column: str = "doc_id", md_column: str = "md") -> DataFrame:
    """(id, entity, i, j, first, second): pairs of sentences of a report that name the same thing, drawn by stride: at most `per_cluster` for a thing and `in_all` for a report, things in most sentences first.

    Limits are what a judge is asked at most. Pairs of equal sentences are left out and don't count.
    """
    parts = reports.select(id_column, text.prose_sentences(F.coalesce(F.col(md_column), F.lit(""))).alias("sentences")).where(F.size("sentences") >= 6)
    parts = materialised(parts.withColumn("named", F.transform("sentences", text.entities)))
    named = parts.select(id_column, F.posexplode("named").alias("i", "entities")).select(id_column, "i", F.posexplode("entities").alias("n", "entity"))
    clusters = named.groupBy(id_column, "entity").agg(F.sort_array(F.collect_list("i")).alias("at"), F.min(F.struct("i", "n")).alias("first")).where(F.size("at") >= 2)
    ordered = clusters.groupBy(id_column).agg(F.sort_array(F.collect_list(F.struct((-F.size("at")).alias("size"), "first", "entity", "at"))).alias("clusters"))
    both = ordered.join(parts.select(id_column, "sentences"), id_column)

    def strided(at: Column, most: Column) -> Column:
        """At most so many of all pairs of `at` in order, told by their numbers, as a long report has too many pairs to list."""
        n = F.size(at).cast("long")
        pairs = (n * (n - 1)) / 2
        all_ = pairs.cast("long")
        stride = F.when(all_ <= most, F.lit(1)).otherwise(F.greatest(F.lit(1), F.floor(pairs / F.greatest(most, F.lit(1)))).cast("long"))
        drawn = F.least(all_, F.greatest(most, F.lit(0)).cast("long"))
        before = lambda i: (i * (2 * n - i - 1) / 2).cast("long")  # noqa: E731  pairs whose first is among the first i

        def pair(k: Column) -> Column:
            near = F.floor((2 * n - 1 - F.sqrt(((2 * n - 1) * (2 * n - 1) - 8 * k).cast("double"))) / 2).cast("long")
            i = F.when(before(near) > k, near - 1).when(before(near + 1) <= k, near + 1).otherwise(near)
            return text.let(i, lambda i: F.struct(F.get(at, i.cast("int")).alias("i"), F.get(at, (k - before(i) + i + 1).cast("int")).alias("j")))

        return text.let(stride, lambda s: F.transform(F.filter(F.sequence(F.lit(0).cast("long"), F.greatest(drawn - 1, F.lit(0))), lambda k: k < drawn), lambda k: pair(k * s)))

    kind = "array<struct<entity:string,i:int,j:int>>"

    def step(so_far: Column, cluster: Column) -> Column:
        room = F.least(F.lit(per_cluster), in_all - F.size(so_far))
        drawn = F.transform(text.let(room, lambda most: strided(cluster["at"], most)), lambda p: F.struct(cluster["entity"].alias("entity"), p["i"].alias("i"), p["j"].alias("j")))
        differ = F.filter(drawn, lambda p: F.get("sentences", p["i"]) != F.get("sentences", p["j"]))
        return F.when(F.size(so_far) >= in_all, so_far).otherwise(F.concat(so_far, differ))

    drawn = F.aggregate("clusters", F.array().cast(kind), step)
    return both.select(id_column, "sentences", F.explode(drawn).alias("p")).select(id_column, "p.*", F.get("sentences", F.col("p.i")).alias("first"), F.get("sentences", F.col("p.j")).alias("second"))


def internal_consistency(reports: DataFrame, judged: DataFrame, min_score: float = 0.85, id_column: str = "doc_id", md_column: str = "md", pairs: DataFrame | None = None) -> DataFrame:
    """Share of a report's pairs of sentences (consistency_pairs) that don't contradict: judged (pair_hash, verdict) by xxhash64 of entity and both sentences.

    A degenerate report (under 80 words) fails with 0.0; one without pairs is not concerned: 1.0. pairs: those of
    consistency_pairs, if they are at hand.
    """
    pairs = (consistency_pairs(reports, id_column=id_column, md_column=md_column) if pairs is None else pairs).withColumn("pair_hash", F.xxhash64("entity", "first", "second"))
    verdicts = judged.groupBy("pair_hash").agg(F.max(F.upper("verdict")).alias("verdict"))
    counted = pairs.join(verdicts, "pair_hash", "left").groupBy(id_column).agg(F.count("*").alias("pairs"), F.count_if(F.col("verdict") == "CONTRADICT").alias("contradictions"))
    out = _per_report(reports, counted, id_column, ["pairs", "contradictions"]).join(degenerate(reports, 80, False, id_column, md_column), id_column)
    score = F.when(F.col("degenerate"), 0.0).otherwise(1 - _share("contradictions", "pairs"))
    return out.select(id_column, "pairs", "contradictions", "degenerate", (~F.col("degenerate") & (F.col("pairs") > 0)).alias("applicable"), _rounded(score).alias("score"), (score >= min_score).alias("passed"))


def citation_check(reports: DataFrame, pages: DataFrame, hosts: list[str] | None = None, min_sources: int = 1, id_column: str = "doc_id", md_column: str = "md") -> DataFrame:
    """Precision, recall and F1 of a prose report's distinct URLs: one is supported if its page, (url, status, body), has half of the words of its snippet.

    The snippet is a link's label, with the sentence before it if the label has fewer than two words; its first six
    words of three or more letters and digits count. URLs elsewhere than `hosts` (any, if none are given), and pages
    that weren't reached, are not supported. Recall is against `min_sources`. passed is a perfect run.
    """

    def cited(body: Column) -> Column:
        label = lambda m: F.regexp_extract(m["hit"], r"(?s)^\[([^\]]*)\]", 1)

        def before(m: Column) -> Column:
            lead = text.window(body, m["at"], m["at"], 400)
            lead = F.left(lead, F.least(m["at"], F.lit(400)))
            return text.strip(F.regexp_replace(lead, r"(?s)^.*(?:\n\n|\. |! |\? |\n)", ""))

        snippet = lambda m: F.when(F.regexp_count(label(m), F.lit(r"[A-Za-z0-9]{3,}")) < 2, F.trim(F.concat_ws(" ", before(m), label(m)))).otherwise(label(m))
        links = F.transform(text.found(body, text.MD_LINK), lambda m: F.struct(F.regexp_extract(m["hit"], text.MD_URL, 1).alias("url"), snippet(m).alias("snippet")))
        bare = F.transform(F.regexp_extract_all(body, F.lit(r"""(?U)https?://[^\s<>"')\]]+"""), F.lit(0)), lambda u: F.struct(F.regexp_replace(u, r"[.,;:!?)]+$", "").alias("url"), F.lit("").alias("snippet")))
        return text.let(F.concat(links, bare), lambda all_: F.filter(all_, lambda c, i: ~F.array_contains(F.transform(F.slice(all_, 1, i), lambda d: d["url"]), c["url"])))

    rows = reports.select(id_column, F.explode(text.let(F.coalesce(F.col(md_column), F.lit("")), cited)).alias("c")).select(id_column, "c.url", F.slice(F.regexp_extract_all(F.lower("c.snippet"), F.lit(r"[a-z0-9]{3,}"), F.lit(0)), 1, 6).alias("words"))
    known = pages.groupBy("url").agg(F.min(F.struct(F.col("status").cast("int").alias("status"), F.lower("body").alias("body"))).alias("page"))
    met = rows.join(known, "url", "left")
    inside = url.host_in(F.col("url"), hosts) if hosts else F.lit(True)
    reached = inside & F.coalesce(F.col("page.status") == 200, F.lit(False))
    hits = F.size(F.filter("words", lambda w: F.contains(F.col("page.body"), w)))
    supported = reached & (F.size("words") > 0) & (hits >= 0.5 * F.size("words"))
    counted = met.groupBy(id_column).agg(F.count("*").alias("citations"), F.count_if(supported).alias("supported"), F.count_if(reached).alias("sources"))
    out = _per_report(reports, counted, id_column, ["citations", "supported", "sources"])
    precision, recall = _share("supported", "citations"), F.least(F.lit(1.0), F.col("supported") / max(1, min_sources))
    f1 = _share(2 * precision * recall, precision + recall)
    perfect = (recall == 1.0) & (precision == 1.0) & (F.col("sources") >= min_sources) & (F.col("citations") > 0)
    return out.select(id_column, "citations", "supported", "sources", _rounded(precision, 3).alias("precision"), _rounded(recall, 3).alias("recall"), _rounded(f1, 3).alias("score"), perfect.alias("passed"))


