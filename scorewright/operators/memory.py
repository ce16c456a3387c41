"""What past runs teach: memory of tasks, of kinds of tasks, and of all, mined from qualified runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorewright.functions import text
from scorewright.operators.retrieval import intent

# What a run must reach to be remembered, how many runs and tasks are, and where each site's links go.
LEAST_COMPOSITE, LEAST_REACH, KEPT = 0.04, 0.20, 5
SITES = {"shopping": ":7770", "reddit": ":9999", "wiki": ":8090"}


def sections(md: Column, most: int = 20) -> Column:
    """Titles of a report's headings of the first three levels, in order, `most` of them."""
    titles = F.regexp_extract_all(F.coalesce(md, F.lit("")), F.lit(r"(?mdU)^#{1,3}\s+(.+)$"), F.lit(1))
    return F.slice(F.transform(titles, text.strip), 1, most)


def url_patterns(md: Column) -> Column:
    """(shopping, reddit, wiki): links of a report to each site, each once, in order."""
    links = F.array_distinct(F.regexp_extract_all(F.coalesce(md, F.lit("")), F.lit(r"\]\((http://localhost:\d+/[^)]+)\)"), F.lit(1)))
    names = list(SITES)

    def to(name: str) -> Column:
        before = names[: names.index(name)]  # a link that names two ports counts for the first
        return F.filter(links, lambda u: F.contains(u, F.lit(SITES[name])) & ~F.exists(F.array(*(F.lit(SITES[b]) for b in before)).cast("array<string>"), lambda p: F.contains(u, p)))

    return F.struct(*(to(n).alias(n) for n in names))


def qualified(runs: DataFrame) -> DataFrame:
    """Runs that count: composite and reach from the thresholds on. Null ones don't."""
    return runs.where((F.col("composite") >= LEAST_COMPOSITE) & (F.col("reach") >= LEAST_REACH))


def of_tasks(runs: DataFrame) -> DataFrame:
    """(task, intent_type, best_runs, section_skeleton, cited_url_patterns): memory of each task.

    runs have agent, task, intent, composite, reach, citations, recall, per_domain (map<string,int>), checklist and md.
    The best KEPT runs by composite, ties by agent; the skeleton is that of the first agent with any sections, the
    links those of the last agent with a report. Null counts are zero. One row of a task is bounded by its agents.
    """
    rows = qualified(runs).withColumns({"_sections": sections(F.col("md")), "_links": F.when(F.col("md").isNotNull(), url_patterns(F.col("md")))})
    zero = lambda c: F.coalesce(c, F.lit(0))
    run = F.struct("agent", F.col("composite").alias("composite_v2"), F.col("reach").alias("reachability"), zero("citations").alias("citation_count"), zero("recall").alias("must_cite_recall"), "per_domain", zero("checklist").alias("checklist_pass_rate"))
    place = F.row_number().over(Window.partitionBy("task").orderBy(F.desc("composite"), "agent"))
    best = rows.select("task", place.alias("place"), run.alias("run")).where(F.col("place") <= KEPT).groupBy("task").agg(F.map_from_entries(F.collect_list(F.struct("place", "run"))).alias("_best"))
    best = best.select("task", F.transform(F.array_sort(F.map_keys("_best")), lambda k: F.element_at("_best", k)).alias("best_runs"))  # a run has a map, which can't be ordered
    skeleton = F.min_by("_sections", F.when(F.size("_sections") > 0, F.col("agent")))
    told = rows.groupBy("task").agg(F.min_by(intent(F.col("intent")), "agent").alias("intent_type"), F.coalesce(skeleton, F.array().cast("array<string>")).alias("section_skeleton"), F.max_by("_links", F.when(F.col("_links").isNotNull(), F.col("agent"))).alias("cited_url_patterns"))
    return told.join(best, "task").select("task", "intent_type", "best_runs", "section_skeleton", "cited_url_patterns")


def of_intents(runs: DataFrame) -> DataFrame:
    """(intent_type, n_tasks, n_runs, avg_citation_count, section_count_avg, citation_distribution, exemplar_tasks, usual_sections): memory of each kind of task.

    The distribution has each domain's share of all citations; exemplars are the tasks of the best runs, ties by name.
    usual_sections has the titles that half or more of the reports with sections have, by the middle of their places.
    """
    rows = qualified(runs).withColumns({"intent_type": intent(F.col("intent")), "_sections": sections(F.col("md")), "_cited": F.coalesce("citations", F.lit(0))})
    counts = rows.groupBy("intent_type").agg(F.count_distinct("task").alias("n_tasks"), F.count("*").alias("n_runs"), F.round(F.avg("_cited") + 1e-9, 1).alias("avg_citation_count"), F.round(F.coalesce(F.avg(F.when(F.size("_sections") > 0, F.size("_sections"))), F.lit(0.0)) + 1e-9, 1).alias("section_count_avg"), F.count_if(F.size("_sections") > 0).alias("_outlined"))
    domains = rows.select("intent_type", F.explode("per_domain").alias("domain", "n")).groupBy("intent_type", "domain").agg(F.sum("n").alias("n"))
    total = F.sum("n").over(Window.partitionBy("intent_type"))
    shares = domains.withColumn("share", F.round(F.col("n") / F.when(total > 0, total).otherwise(1) + 1e-9, 3)).groupBy("intent_type").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("domain", "share")))).alias("citation_distribution"))
    tasks = rows.groupBy("intent_type", "task").agg(F.max("composite").alias("best"))
    place = F.row_number().over(Window.partitionBy("intent_type").orderBy(F.desc("best"), "task"))
    exemplars = tasks.withColumn("place", place).where(F.col("place") <= KEPT).groupBy("intent_type").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "task"))), lambda x: x["task"]).alias("exemplar_tasks"))
    titles = rows.select("intent_type", F.posexplode("_sections").alias("at", "title")).groupBy("intent_type", "title").agg(F.count("*").alias("n"), F.percentile("at", F.lit(0.5)).alias("middle"))
    usual = titles.join(counts.select("intent_type", "_outlined"), "intent_type").where(F.col("n") * 2 >= F.col("_outlined")).groupBy("intent_type").agg(F.transform(F.sort_array(F.collect_list(F.struct("middle", "title"))), lambda x: x["title"]).alias("usual_sections"))
    out = counts.drop("_outlined").join(shares, "intent_type", "left").join(exemplars, "intent_type", "left").join(usual, "intent_type", "left")
    return out.withColumns({"citation_distribution": F.coalesce("citation_distribution", F.create_map().cast("map<string,double>")), "usual_sections": F.coalesce("usual_sections", F.array().cast("array<string>"))})


def of_all(tasks: DataFrame) -> DataFrame:
    """One row over of_tasks(): n_total_l1_entries, n_total_qualified_runs, and hundredths of the least and greatest composite remembered (60 and 120 without any)."""
    runs = tasks.select(F.explode("best_runs").alias("r"))
    range_ = runs.agg(F.count("*").alias("n_total_qualified_runs"), F.coalesce(F.floor(F.min("r.composite_v2") * 100 + 1e-9), F.lit(60)).cast("int").alias("typical_low"), F.coalesce(F.floor(F.max("r.composite_v2") * 100 + 1e-9), F.lit(120)).cast("int").alias("typical_high"))
    return tasks.agg(F.count("*").alias("n_total_l1_entries")).join(F.broadcast(range_))
