"""Plans of battles still to fight, and audits of scores against the reports and facts that they rest on."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorewright.functions import text, url
from scorewright.operators.aggregates import missing_pairs
from scorewright.operators.citations import citations
from scorewright.storage import materialised

# What a made-up URL looks like, and words of a run that gave up.
FAKE_URLS = [r"\(placeholder\)", r"example\.com", r"wikipedia\.org", r"\.tavily\.", r"onestopmarket\.com"]
GAVE_UP = "failed to finish"


def _draw(most: Column, *names: object) -> Column:
    """A number from 0 to below `most`, by the digest of the names, so that a lost task draws it again."""
    key = F.concat_ws("/", *(F.lit(n) if isinstance(n, (int, str)) and not isinstance(n, Column) else n.cast("string") for n in names))
    return F.pmod(F.conv(F.left(F.md5(key), F.lit(8)), 16, 10).cast("long"), most)


def top_pairs(board: DataFrame, n: int) -> DataFrame:
    """(a, b) of the n best agents of a board (agent, rating), a before b by name; a board has a row an agent."""
    best = board.orderBy(F.desc("rating"), "agent").limit(n).select("agent")
    return best.select(F.col("agent").alias("a")).join(best.select(F.col("agent").alias("b")), F.col("a") < F.col("b"))


def densified(board: DataFrame, runs: DataFrame, judges: list[str], n: int, each: int, seed: int = 17) -> DataFrame:
    """(a, b, draw, task, judge): for each pair of the n best agents `each` battles, tasks drawn with replacement from those that both have run, each for every judge. Pairs without a common task have none."""
    pairs = top_pairs(board, n)
    both = pairs.join(runs.select(F.col("agent").alias("a"), "task").distinct(), "a").join(runs.select(F.col("agent").alias("b"), "task").distinct(), ["b", "task"])
    common = both.groupBy("a", "b").agg(F.sort_array(F.collect_set("task")).alias("tasks"))
    drawn = common.select("a", "b", "tasks", F.explode(F.sequence(F.lit(1), F.lit(each))).alias("draw"))
    place = _draw(F.size("tasks"), seed, F.col("a"), F.col("b"), F.col("draw"))
    return drawn.select("a", "b", "draw", F.get("tasks", place.cast("int")).alias("task"), F.explode(F.array(*map(F.lit, judges))).alias("judge"))


def pair_queue(board: DataFrame, tasks: DataFrame, n: int = 5, seed: int = 17) -> DataFrame:
    """(place, task, a, b): every pair of the n best agents on every task (task), in an order drawn by digest; place is the digest, to sort by."""
    queue = tasks.select("task").distinct().join(F.broadcast(top_pairs(board, n)))
    return queue.select(F.md5(F.concat_ws("/", F.lit(seed), "task", "a", "b")).alias("place"), "task", "a", "b")


def task_coverage(rows: DataFrame, golden: DataFrame) -> DataFrame:
    """(task, scored, kept, missing, must_urls, sources, status) from rows (agent, task, kept) and golden (task, url): who is missing of all agents, and whether a task has three sources."""
    gaps = missing_pairs(rows, "task", "agent").groupBy("task").agg(F.array_join(F.sort_array(F.collect_list("agent")), ", ").alias("missing"))
    per = rows.groupBy("task").agg(F.count_distinct("agent").alias("scored"), F.count_distinct(F.when(F.col("kept"), F.col("agent"))).alias("kept"))
    known = golden.groupBy("task").agg(F.count("*").alias("must_urls"), F.count_distinct(url.host_port(F.col("url"))).alias("sources"))
    out = per.join(gaps, "task", "left").join(known, "task", "left").fillna("", subset=["missing"]).fillna(0, subset=["must_urls", "sources"])
    return out.withColumn("status", F.when(F.col("must_urls") == 0, "NO_GOLDEN").when(F.col("sources") < 3, "THIN").otherwise("OK"))


def disagreements(prefs: DataFrame, scores: DataFrame, n: int = 10) -> DataFrame:
    """(pref_id, a, b, winner, predicted, gap): the n preferences (pref_id, a, b, winner) that scores (agent, score) most contradict; ties on either side don't."""
    left, right = (scores.select(F.col("agent").alias(side), F.col("score").alias(f"_{side}")) for side in ("a", "b"))
    both = prefs.where("winner in ('a', 'b')").join(left, "a").join(right, "b")
    predicted = F.when(F.col("_a") > F.col("_b"), "a").when(F.col("_b") > F.col("_a"), "b")
    return both.withColumns({"predicted": predicted, "gap": F.abs(F.col("_a") - F.col("_b"))}).where("predicted != winner").orderBy(F.desc("gap"), "pref_id").limit(n).select("pref_id", "a", "b", "winner", "predicted", "gap")


def fairness(reports: DataFrame, must: DataFrame, scored: DataFrame, id_column: str = "doc_id", scorer_first: bool = False) -> DataFrame:
    """(id, cited, direct, near, scored_hits, verdict): a report's URLs against its task's must (task, url), by canonical URL and by host and end of the path.

    SUSPECT if only near misses are found, else DRIFT if the scorer, scored (id, hits), counted other hits, else FAIR.
    With scorer_first, as in audits of single pairs, a report without text or a task without must is a SKIP, and DRIFT
    is asked for before SUSPECT.
    """
    stem = lambda u: F.concat(url.host_port(u), F.lit("/"), F.lower(F.array_join(F.slice(F.split(F.regexp_replace(url.part(u, 4), "/+$", ""), "/"), F.greatest(F.size(F.split(F.regexp_replace(url.part(u, 4), "/+$", ""), "/")) - 1, F.lit(1)), 2), "/")))
    # Written once, as three counts are taken from it; texts are gone through for it once.
    cited = materialised(citations(reports, None, id_column, wanted=("url",), beside=("task",)).distinct())
    known = must.select("task", url.canonical(F.col("url")).alias("url")).distinct()
    direct = cited.join(known, ["task", "url"]).groupBy(id_column).agg(F.count("*").alias("direct"))
    near = cited.select(id_column, "task", F.col("url").alias("own"), stem(F.col("url")).alias("stem")).join(known.select("task", "url", stem(F.col("url")).alias("stem")), ["task", "stem"]).where("own != url").groupBy(id_column).agg(F.count_distinct("stem").alias("near"))
    counts = cited.groupBy(id_column).agg(F.count("*").alias("cited"))
    out = reports.select(id_column).join(counts, id_column, "left").join(direct, id_column, "left").join(near, id_column, "left").join(scored.select(id_column, F.col("hits").alias("scored_hits")), id_column, "left").fillna(0)
    suspect, drift = (F.col("near") > 0) & (F.col("direct") == 0), F.col("scored_hits") != F.col("direct")
    if not scorer_first:
        return out.withColumn("verdict", F.when(suspect, "SUSPECT").when(drift, "DRIFT").otherwise("FAIR"))
    asked = known.select("task").distinct().withColumn("_asked", F.lit(True))
    given = reports.select(id_column, "task", (F.coalesce("md", F.lit("")) != "").alias("_given")).join(asked, "task", "left").drop("task")
    skip = ~F.col("_given") | F.col("_asked").isNull()
    return out.join(given, id_column).withColumn("verdict", F.when(skip, "SKIP").when(drift, "DRIFT").when(suspect, "SUSPECT").otherwise("FAIR")).drop("_given", "_asked")


def flag_counts(faults: DataFrame, *by: str) -> DataFrame:
    """(by, fault, primary, n): how often each primary fault, and each flag beside it, is among the rows of taxonomy()."""
    each = F.concat(F.array(F.struct(F.col("primary_fault").alias("fault"), F.lit(True).alias("primary"))), F.transform(F.filter(F.split("flags", ","), lambda f: f != ""), lambda f: F.struct(f.alias("fault"), F.lit(False).alias("primary"))))
    return faults.select(*by, F.explode(each).alias("f")).groupBy(*by, "f.fault", "f.primary").agg(F.count("*").alias("n"))


def taxonomy(reports: DataFrame, hosts: list[str], id_column: str = "doc_id", md_column: str = "md") -> DataFrame:
    """(id, primary_fault, flags, words, cites, off_sandbox): what went wrong with a report, the first that fits, and flags beside it.

    Links to none of `hosts`, or made-up URLs, are hallucinations; so is a long report without any link.
    """
    body = F.coalesce(F.col(md_column), F.lit(""))
    links = F.transform(F.regexp_extract_all(body, F.lit(r"(?U)\[[^\]]+\]\((https?://[^)\s]+)\)"), F.lit(1)), lambda u: F.lower(F.regexp_extract(u, r"^https?://([^/]+)", 1)))
    known = lambda h: reduce(lambda a, x: a | F.contains(h, F.lit(x)), hosts, F.lit(False))
    out = reports.select(id_column, text.tokens(body).alias("words"), F.size(links).alias("cites"), F.array_distinct(F.filter(links, lambda h: h != "")).alias("hosts"), F.size(F.filter(links, lambda h: (h != "") & ~known(h))).alias("off_sandbox"), (text.phrase_hits(body, FAKE_URLS) > 0).alias("fake"), F.startswith(text.strip(body), F.lit('{"markdown_report"')).alias("wrapped"), F.contains(F.lower(body), F.lit(GAVE_UP)).alias("gave_up"))
    fault = F.when((F.col("words") < 50) | F.col("gave_up"), "timeout_or_empty").when(F.col("wrapped") & (F.col("words") < 400), "format_error").when(F.col("fake") | (F.col("off_sandbox") >= 2) | (F.col("cites") == 0) & (F.col("words") >= 200), "hallucination_url").otherwise("ok")
    flag = {"no_inline_cites": F.col("cites") == 0, "zero_wiki_cites": ~F.exists("hosts", lambda h: F.contains(h, F.lit("8090"))), "only_one_source_host": F.size("hosts") == 1, "answer_wrapped_in_json": F.col("wrapped"), "very_short_report": F.col("words") < 500, "very_long_report": F.col("words") > 3500}
    flags = F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in flag.items())))
    return out.select(id_column, fault.alias("primary_fault"), F.array_join(flags, ",").alias("flags"), "words", "cites", "off_sandbox")


def inversions(rows: DataFrame, old: str, new: str, name: str) -> DataFrame:
    """(name, old_rank, new_rank, delta) by two scores of a board, ties by name; a board has a row a name."""
    place = lambda c: F.row_number().over(Window.orderBy(F.desc(c), name)).cast("long")
    return rows.select(name, place(old).alias("old_rank"), place(new).alias("new_rank")).withColumn("delta", F.col("old_rank") - F.col("new_rank"))


def reward(reports: DataFrame, dims: DataFrame, judged: bool, least_citations: int = 30, trace: DataFrame | None = None, id_column: str = "doc_id", md_column: str = "md") -> DataFrame:
    """(id, quote_match, reach, q_value, composite): the soft-floored composite of a report for training.

    dims has (id, coverage, spec) and, where judged, depth, rigor, style and checklist; otherwise these four are a
    neutral 0.5, as is a null. Without a trace (id, quote_match, reach), or where it has nulls, links against
    `least_citations` stand for both signals.
    """
    # Weights of the dimensions.
    weights = {"coverage": 0.20, "depth": 0.20, "rigor": 0.20, "style": 0.10, "checklist": 0.20, "spec": 0.10}
    links = (F.char_length(F.coalesce(F.col(md_column), F.lit(""))) - F.char_length(F.replace(F.coalesce(F.col(md_column), F.lit("")), F.lit("]("), F.lit("")))) / 2
    proxy = F.least(F.lit(1.0), links / least_citations) if least_citations > 0 else F.lit(0.0)
    out = reports.select(id_column, proxy.alias("_proxy")).join(dims, id_column, "left")
    out = out.withColumns({"_qm": F.lit(None).cast("double"), "_reach": F.lit(None).cast("double")}) if trace is None else out.join(trace.select(id_column, F.col("quote_match").alias("_qm"), F.col("reach").alias("_reach")), id_column, "left")
    value = lambda d: F.lit(0.5) if not judged and d not in ("coverage", "spec") else F.coalesce(F.col(d).cast("double"), F.lit(0.5))
    q = sum((w * value(d) for d, w in weights.items()), F.lit(0.0))
    qm = F.coalesce("_qm", "_proxy")
    soft = F.least(F.lit(1.0), F.greatest(F.lit(0.5), 0.5 + 0.5 * qm))
    return out.select(id_column, F.round(qm, 6).alias("quote_match"), F.round(F.coalesce("_reach", "_proxy"), 6).alias("reach"), F.round(q + 1e-9, 6).alias("q_value"), F.round(soft * q + 1e-9, 6).alias("composite"))
