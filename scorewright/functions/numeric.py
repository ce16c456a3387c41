"""Numbers in texts, tolerances, entropies, grades."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_number(text: Column) -> Column:
    """The first number, commas between digits taken out; null if there is none."""
    return F.regexp_extract(F.regexp_replace(text, r"(?<=\d),(?=\d)", ""), r"(-?\d+(?:\.\d+)?)", 1).try_cast("double")


def close(a: Column, b: Column, tolerance: float) -> Column:
    """|a - b| over the larger magnitude within the tolerance; two zeros are close."""
    return F.abs(a - b) / F.greatest(F.abs(a), F.abs(b), F.lit(1e-9)) <= tolerance


def price_range(text: Column) -> Column:
    """(low, high) of '$a-$b' or '$a to $b'."""
    pattern = r"\$(\d+(?:\.\d+)?)\s*(?:-|to)\s*\$(\d+(?:\.\d+)?)"
    return F.struct(F.regexp_extract(text, pattern, 1).try_cast("double").alias("low"), F.regexp_extract(text, pattern, 2).try_cast("double").alias("high"))


def entropy(counts: Column) -> Column:
    """Shannon entropy of an array of counts over the log of how many there are; zero for one or none."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    bits = F.aggregate(counts, F.lit(0.0), lambda a, x: a - F.when(x > 0, (x / total) * F.ln(x / total)).otherwise(0.0))
    return F.when(F.size(counts) <= 1, 0.0).otherwise(bits / F.ln(F.greatest(F.size(counts), F.lit(2)).cast("double")))


def share_score(share: Column, full: float = 0.35, none: float = 0.60) -> Column:
    """1 up to `full`, 0 from `none` on, a line between."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (none - share) / (none - full)))


def decay(value: Column, budget: float) -> Column:
    """1 within the budget, 0 at three times it."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (3 * budget - value) / (2 * budget)))


def grade(score: Column) -> Column:
    # Least scores of grades.
    label = None
    for least, name in ((0.95, "A+"), (0.9, "A"), (0.85, "B+"), (0.8, "B"), (0.7, "C"), (0.6, "D")):
        label = F.when(score >= least, name) if label is None else label.when(score >= least, name)
    return label.otherwise("F")


def evidence_density(products: Column, posts: Column, meta: Column, enough_products: int = 6, enough_posts: int = 4) -> Column:
    """0.4 for enough products, 0.3 for enough posts, 0.3 for words that are not about the report itself."""
    return 0.4 * F.least(F.lit(1.0), products / enough_products) + 0.3 * F.least(F.lit(1.0), posts / enough_posts) + 0.3 * F.greatest(F.lit(0.0), 1 - meta)


def cost_efficiency(cost: Column, seconds: Column, budget: float = 0.10, time_budget: float = 300.0) -> Column:
    """Seven tenths for cost and three for time, each full within its budget and nothing at three times it."""
    return 0.7 * decay(cost, budget) + 0.3 * decay(seconds, time_budget)


def cosine(a: Column, b: Column) -> Column:
    """Of two arrays of numbers; zero if a norm is next to nothing."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm < 1e-9, 0.0).otherwise(dot(a, b) / F.nullif(norm, F.lit(0.0)))


NUMBER = r"-?[0-9]+(?:[.,][0-9]+)?"


def canonical_number(text: Column) -> Column:
    """The first number of a text in one form: no marks between thousands; a point before one or two digits is a decimal one. Null if there is none."""
    raw = F.nullif(F.regexp_extract(text, NUMBER, 0), F.lit(""))
    return F.when(raw.rlike(r"^-?[0-9]+\.[0-9]{1,2}$"), raw).otherwise(F.regexp_replace(raw, "[.,]", ""))


def value_in_page(value: Column, kind: Column, page: Column) -> Column:
    """Whether a page has a value: as it stands, whatever its case, or by the rule of its kind.

    A price equals one of the page's prices, a percentage one of its percentages, counts and measures one of its
    numbers, all by canonical form; of a relation the page has the first eight words of three or more characters.
    Null and empty values and pages give false.
    """
    v, low = F.trim(value), F.lower(page)
    among = lambda pattern, own: F.array_contains(F.transform(F.regexp_extract_all(page, F.lit(pattern), F.lit(1)), canonical_number), canonical_number(own))
    words = F.slice(F.filter(F.split(F.lower(v), r"\s+"), lambda w: F.char_length(w) >= 3), 1, 8)
    by_kind = (
        F.when(kind == "price", among(r"[$£€¥]\s?([0-9]+(?:[.,][0-9]+)?)", v))
        .when(kind == "percentage", among(r"([0-9]+(?:[.,][0-9]+)?)\s*%", v))
        .when(kind.isin("count", "duration", "rating", "frequency", "dimension", "weight", "version"), among(f"({NUMBER})", v))
        .when(kind == "relation", (F.size(words) > 0) & F.forall(words, lambda w: F.contains(low, w)))
        .otherwise(F.lit(False))
    )
    return F.when((F.coalesce(value, F.lit("")) == "") | (F.coalesce(page, F.lit("")) == ""), False).otherwise(F.contains(low, F.lower(v)) | F.coalesce(by_kind, F.lit(False)))
