"""Measures of reports and prose as columns. Null texts give null unless a function says otherwise."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from scorewright.functions import numeric

# Patterns of citations in reports.
MD_LINK = r"(?U)\[[^\]]*\]\(https?://[^)\s]+\)"
MD_URL = r"(?U)\[[^\]]*\]\((https?://[^)\s]+)\)"
MD_LABEL = r"(?U)\[([^\]]*)\]\(https?://[^)\s]+\)"
BARE_URL = r"""(?U)(?<![(\[])https?://[^\s<>"'`)\]]+"""
SOURCE_URL = r"(?iU)\b(?:Source|URL|Link|See|Reference|Ref|Available\s+at|Cited\s+from)\s*[:=]\s*https?://\S+"
BULLET_URL = r"(?mdU)^[-*+]\s+https?://\S+\s*$"
NUMBER_MARK = r"\[\d{1,3}\]"
NUMBER_LINE = r"(?mdU)^\s*\[(\d{1,3})\]\s*\.?\s*(?:[-:.]\s*)?(.+)$"
FOOTNOTE_MARK = r"(?U)\[\^[\w-]+\]"
FOOTNOTE_LINE = r"(?mdU)^\s*\[\^([\w-]+)\]:\s*(.+)$"

# Words and phrases that the verifiers look for.
CONTRADICTION = r"(?iU)\b(?:however|contrary|contradicts?|disagrees?|disputes?|conflicts?\s+with|at\s+odds|inconsistent|whereas|on\s+the\s+other\s+hand|in\s+contrast|conversely|nevertheless|despite|although|while\s+.{0,30}\s+suggests?|conflicting\s+(?:evidence|data|findings|reports))\b"
COMPARATIVE = r"(?iU)\b(?:compared?\s+to|in\s+comparison|relative\s+to|versus|vs\.?|more\s+than|less\s+than|greater|fewer|higher|lower|better|worse|outperform|underperform|superior|inferior|unlike|similarly|differ(?:s|ent|ence)|contrast|analogous|whereas)\b"
POSITIVE = ["excellent", "outstanding", "superior", "superb", "exceptional", "great", "good", "best", "better", "top", "leading", "premier", "impressive", "remarkable", "stunning", "perfect", "ideal", "recommended", "recommend", "preferable", "preferred", "favorite", "favourite", "powerful", "robust", "reliable", "stable", "consistent", "smooth", "elegant", "clean", "polished", "refined", "premium", "high-quality", "high-end", "professional", "praised", "praises", "praise", "acclaimed", "acclaim", "loved", "loves", "love", "celebrated", "celebrate", "advantage", "advantages", "strength", "strengths", "pro", "pros", "benefit", "benefits", "beneficial", "valuable", "worthwhile", "comfortable", "lightweight", "long-lasting", "long-battery", "clear", "crisp", "rich", "balanced", "natural", "warm", "detailed", "wide-soundstage", "soundstage", "immersive", "punchy", "well-built", "sturdy", "durable", "well-designed", "intuitive", "user-friendly", "seamless", "responsive", "fast", "accurate", "precise", "effective", "efficient", "must-have", "must-buy", "buy", "purchase", "worth", "deserves", "endorse", "endorsement", "support", "supports", "approve", "approves"]
NEGATIVE = ["poor", "bad", "worst", "worse", "inferior", "subpar", "mediocre", "disappointing", "disappointed", "disappoint", "weak", "lackluster", "lacking", "lacks", "lack", "missing", "absent", "deficient", "flawed", "flaw", "flaws", "defective", "defect", "defects", "broken", "buggy", "unstable", "unreliable", "inconsistent", "problem", "problems", "problematic", "issue", "issues", "complain", "complaint", "complaints", "criticized", "criticism", "criticize", "criticizes", "negative", "concerns", "concern", "disadvantage", "disadvantages", "weakness", "weaknesses", "con", "cons", "drawback", "drawbacks", "downside", "downsides", "limitation", "limitations", "limit", "limits", "limited", "compromise", "compromises", "tradeoff", "tradeoffs", "trade-off", "but", "however", "although", "though", "despite", "yet", "terrible", "awful", "horrible", "useless", "worthless", "junk", "garbage", "trash", "fail", "fails", "failed", "failure", "uncomfortable", "heavy", "bulky", "short-battery", "short-lived", "muddy", "harsh", "tinny", "bright", "sibilant", "boomy", "flimsy", "fragile", "cheap-feeling", "plastic", "creaky", "clunky", "unintuitive", "confusing", "laggy", "slow", "inaccurate", "imprecise", "ineffective", "inefficient", "overpriced", "expensive", "costly", "pricey", "not-worth", "not-recommended", "avoid", "skip", "regret", "returned", "refunded", "contradicts", "contradict", "contradiction", "conflicting", "disputed", "dispute", "disagreement", "disagree", "controversial", "questioned", "questionable"]
STOP_WORDS = ["the", "a", "an", "is", "are", "was", "were", "be", "been", "being", "of", "to", "in", "on", "for", "with", "and", "or", "but", "as", "at", "by", "from", "this", "that", "these", "those", "it", "its", "their", "his", "her", "our", "your", "we", "you", "they", "i", "he", "she", "has", "have", "had", "do", "does", "did", "will", "would", "can", "could", "should", "may", "might", "shall", "must"]
REFUSALS = [r"could not (?:find|locate|verify|retrieve)", r"no (?:evidence|records?|results?|sources?) (?:found|available)", r"does not (?:appear to )?exist", r"cannot (?:find|confirm|verify)", r"unable to (?:find|verify|retrieve|locate)", r"no reliable sources?", r"not (?:found|available) in (?:the|any)", r"i (?:was|am) unable to", r"there (?:is|are) no (?:available |reliable )?(?:data|evidence|sources?)", r"fabricated|invented|fictitious"]
HEDGES = [r"reportedly", r"allegedly", r"could not (?:be )?verif", r"based on limited", r"unverified", r"if (?:it )?exists"]
DEGENERATE = ["(empty ", "(runner error", "(error", "(timeout", "(no output"]
NO_ENTITIES = ["the", "a", "an", "this", "that", "these", "those", "i", "you", "he", "she", "it", "we", "they", "however", "moreover", "furthermore", "nevertheless", "nonetheless", "additionally", "specifically", "particularly", "instead", "rather", "first", "second", "third", "fourth", "fifth", "last", "next", "later", "amazon", "google", "microsoft", "apple", "section", "table", "figure", "chapter", "part", "for example", "in particular", "of course", "in fact", "as shown", "see also", "for instance", "in contrast", "on average", "review", "reviews", "product", "products", "user", "users", "customer", "people", "many", "some", "most", "few", "all", "several"]


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is worked out once for each row however often `use` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def found(text: Column, pattern: Column | str) -> Column:
    """Array of (at, hit): where each match of the pattern begins, in code points from 0, and what it is."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    cut = F.struct(F.split(text, pattern).alias("gaps"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("hits"))

    def place(c: Column) -> Column:
        start = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<at:int,hit:string>>").alias("out"))

        def step(so_far: Column, pair: Column) -> Column:
            at = so_far["end"] + F.char_length(pair["gaps"])
            return F.struct((at + F.char_length(pair["hits"])).alias("end"), F.concat(so_far["out"], F.array(F.struct(at.alias("at"), pair["hits"].alias("hit")))).alias("out"))

        return F.aggregate(F.filter(F.arrays_zip(c["gaps"], c["hits"]), lambda p: p["hits"].isNotNull()), start, step, lambda a: a["out"])

    return let(cut, place)


def words(text: Column) -> Column:
    """Runs of letters, digits, apostrophes and hyphens with a letter or digit, in any script."""
    return _count(text, r"(?U)\b[\w'-]+\b")


def tokens(text: Column) -> Column:
    """How many words stand between white space."""
    return F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""))


def ascii_words(text: Column) -> Column:
    return _count(text, r"[A-Za-z0-9]+")


def plain_words(text: Column) -> Column:
    """Words between white space once links keep their labels only, and code and marks are gone."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\[([^\]]*)\]\([^)]+\)", "$1"), r"`[^`]*`", " "), r"[#>*_~]", " ")
    return tokens(bare)


def blocks(text: Column) -> Column:
    """Blocks between blank lines, stripped, without the blank ones."""
    return F.filter(F.transform(F.split(text, r"(?U)\n\s*\n"), strip), lambda b: b != "")


def paragraphs(text: Column, longer_than: int = 20) -> Column:
    return F.filter(blocks(text), lambda b: F.char_length(b) > longer_than)


def links(text: Column) -> Column:
    """Targets of markdown links of any kind, in order."""
    return F.regexp_extract_all(text, F.lit(r"(?U)\[[^\]]+\]\(([^)\s]+)\)"), F.lit(1))


def urls(text: Column) -> Column:
    """Distinct URLs of a text, linked or bare, without what trails them."""
    from scorewright.functions.url import trimmed

    raw = F.concat(F.regexp_extract_all(text, F.lit(MD_URL), F.lit(1)), F.regexp_extract_all(text, F.lit(BARE_URL), F.lit(0)))
    return F.array_distinct(F.filter(F.transform(raw, trimmed), lambda u: u != ""))


def heading_levels(text: Column) -> Column:
    """How many different depths headings have."""
    return F.size(F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?mdU)^(#{1,6})\s+\S"), F.lit(1))))


def sections(text: Column) -> Column:
    """Texts under second-level headings, and what is before the first; blank ones don't count."""
    return F.filter(F.transform(F.split(text, r"(?mdU)(?=^##\s)"), lambda p: strip(F.regexp_replace(p, r"(?mdU)^##\s+.*$", ""))), lambda p: p != "")


def variation(values: Column) -> Column:
    """Population deviation over mean of an array of doubles; zero if it is empty or its mean is."""

    def spread(v: Column) -> Column:
        mean = F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(v), F.lit(0))
        return let(mean, lambda m: F.when(F.coalesce(m, F.lit(0.0)) == 0, 0.0).otherwise(F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)) / F.size(v)) / F.nullif(m, F.lit(0.0))))

    return let(values, spread)


def sentences(text: Column) -> Column:
    """Pieces between closing marks that aren't blank."""
    return F.size(F.filter(F.split(text, r"[.!?]+"), lambda s: strip(s) != ""))


def syllables(text: Column) -> Column:
    """Groups of vowels of each run of letters, without a silent e at the end of more than two; one at least for each."""
    bare = F.regexp_replace(text, r"(?i)(?<=[a-z]{2})e(?![a-z])", "")
    return let(bare, lambda b: _count(b, r"(?i)[aeiouy]+") + _count(b, r"(?i)(?<![a-z])[b-df-hj-np-tv-xz]+(?![a-z])"))


def reading_ease(text: Column) -> Column:
    """Flesch's formula over runs of letters; zero without words or sentences."""
    counted = F.struct(_count(text, r"[a-zA-Z]+").alias("w"), sentences(text).alias("s"), syllables(text).alias("y"))
    return let(counted, lambda c: F.when((c["w"] == 0) | (c["s"] == 0), 0.0).otherwise(206.835 - 1.015 * (c["w"] / F.nullif(c["s"], F.lit(0))) - 84.6 * (c["y"] / F.nullif(c["w"], F.lit(0)))))


def has_list_or_table(text: Column) -> Column:
    return text.rlike(r"(?mdU)^\s*[-*+]\s|\d+\.\s|^\|.+\|")


def lexicon_counts(text: Column) -> Column:
    """(positive, negative): how many words, hyphens within them included, are in either lexicon."""
    # A word is looked up in a set: a search through the lists would be most of the work.
    own = F.filter(F.split(F.lower(text), r"(?U)[^\w\-]+"), lambda w: w.isin(POSITIVE + NEGATIVE))
    return let(own, lambda w: F.struct(F.size(F.filter(w, lambda x: x.isin(POSITIVE))).alias("positive"), F.size(F.filter(w, lambda x: x.isin(NEGATIVE))).alias("negative")))


def window(text: Column, at: Column, end: Column, around: int) -> Column:
    """The text from `around` characters before `at` to as many after `end`."""
    first = F.greatest(at - around, F.lit(0))
    return F.substring(text, first + 1, end + around - first)


def phrase_hits(text: Column, patterns: list[str]) -> Column:
    """How many of the patterns occur, whatever the case."""
    return sum((text.rlike(f"(?iu){p}").cast("int") for p in patterns), F.lit(0))


def degenerate(text: Column, cited: Column | None = None, min_words: int = 50) -> Column:
    """Why a report is no report: empty_answer, answer_starts_with:..., word_count_too_low:n or zero_citations; null if it is one.

    A null text is empty. `cited` says how many citations it has; without it they are not asked for.
    """
    def reason(body: Column) -> Column:
        low = F.lower(F.left(body, F.lit(max(map(len, DEGENERATE)))))
        found = F.when(body == "", "empty_answer")
        for prefix in DEGENERATE:
            found = found.when(low.startswith(prefix), f"answer_starts_with:{prefix.strip()}")
        return found.otherwise(let(plain_words(body), few))

    def few(count: Column) -> Column:
        found = F.when(count < min_words, F.concat(F.lit("word_count_too_low:"), count.cast("string")))
        return found if cited is None else found.when(F.coalesce(cited, F.lit(0)) == 0, "zero_citations")

    return let(strip(F.coalesce(text, F.lit(""))), reason)


def content_words(text: Column) -> Column:
    """Distinct runs of three or more of a-z and 0-9, without stop words."""
    return F.array_except(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9]{3,}"), F.lit(0))), F.array(*map(F.lit, STOP_WORDS)))


def containment(claim: Column, page: Column) -> Column:
    """Share of the claim's content words that the page has; zero for a claim without any."""
    return F.when(F.size(claim) == 0, 0.0).otherwise(F.size(F.array_intersect(claim, page)) / F.nullif(F.size(claim), F.lit(0)))


# Headings of sections that are about the report itself, and shop pages that are no products.
META_HEADING = r"(?iU)^#{1,6}\s+(methodology|limitations?|future research|future work|survey note|literature review|critical discussion|key citations|research methodology|data extraction|theoretical framework|data access|access limitations|extraction challenges|future research directions)\b"
NO_PRODUCTS = ["home-kitchen", "office-products", "electronics", "health-household", "cell-phones-accessories", "beauty-personal-care", "sports-outdoors", "grocery-gourmet-food", "video-games", "clothing-shoes-jewelry", "baby", "toys-games", "pet-supplies", "tools-home-improvement", "automotive", "patio-lawn-garden", "kitchen-dining", "cell-phones", "computers-accessories", "musical-instruments"]


def product_links(md: Column) -> Column:
    """Distinct products that a report links to: slugs with two hyphens or more, and numbers."""
    slugs = F.transform(F.regexp_extract_all(md, F.lit(r"(?i)http://localhost:7770/([a-z0-9][a-z0-9\-]+)\.html"), F.lit(1)), F.lower)
    named = F.filter(slugs, lambda s: ~s.isin(NO_PRODUCTS) & (F.regexp_count(s, F.lit("-")) >= 2))
    numbers = F.regexp_extract_all(md, F.lit(r"(?i)http://localhost:7770/catalog/product/view/id/(\d+)"), F.lit(1))
    return F.array_distinct(F.concat(named, F.transform(numbers, lambda n: F.concat(F.lit("#"), n))))


def post_links(md: Column) -> Column:
    """Distinct forum posts that a report links to."""
    return F.array_distinct(F.regexp_extract_all(md, F.lit(r"http://localhost:9999/f/[A-Za-z0-9_]+/(\d+)"), F.lit(1)))


def meta_ratio(md: Column) -> Column:
    """Share of a report's words that stand in sections about the report itself; zero for a report without words."""
    parts = F.split(F.concat(F.lit("\n"), md), r"(?dU)\n(?=#{1,6}\s+)")
    under = lambda p: F.when(p.rlike(META_HEADING), tokens(F.regexp_replace(p, r"(?d)^[^\n]*", ""))).otherwise(0)
    return F.coalesce(F.aggregate(F.transform(parts, under), F.lit(0), lambda a, n: a + n) / F.nullif(tokens(md), F.lit(0)), F.lit(0.0))


def evidence(md: Column, products: int = 6, posts: int = 4) -> Column:
    """(products, posts, meta_ratio, score) of a report: links to products and posts against so many of each, and words that are not about the report itself."""
    counted = F.struct(F.size(product_links(md)).alias("products"), F.size(post_links(md)).alias("posts"), meta_ratio(md).alias("meta_ratio"))
    score = lambda c: numeric.evidence_density(c["products"], c["posts"], c["meta_ratio"], products, posts)
    return let(counted, lambda c: F.struct(c["products"].alias("products"), c["posts"].alias("posts"), c["meta_ratio"].alias("meta_ratio"), score(c).alias("score")))


def prose_sentences(text: Column, least: int = 30, most: int = 400) -> Column:
    """Sentences of a report without headings, tables, bullets, links and code, of `least` to `most` characters."""
    flat = text
    for pattern, by in ((r"(?mdU)^#{1,6}\s+.*$", ""), (r"(?md)^\|.+\|$", ""), (r"(?mdU)^\s*[-*+]\s+", ""), (MD_LABEL, "$1"), (r"`[^`]*`", " "), (r"(?U)\s+", " ")):
        flat = F.regexp_replace(flat, pattern, by)
    return F.filter(F.transform(F.split(strip(flat), r"(?U)(?<=[.!?])\s+"), strip), lambda s: F.char_length(s).between(least, most))


def entities(sentence: Column) -> Column:
    """Names in a sentence, in lower case: two to four words with capitals in a row, or one with a digit or hyphen."""
    names = F.transform(F.regexp_extract_all(sentence, F.lit(r"(?U)\b([A-Z][A-Za-z0-9\-]*(?:\s+[A-Z][A-Za-z0-9\-/&]*){0,3})\b"), F.lit(1)), strip)
    noise = F.array(*map(F.lit, NO_ENTITIES))
    named = F.filter(names, lambda n: ~F.array_contains(noise, F.lower(n)) & (n.rlike(r"(?U)\s") | n.rlike(r"[0-9\-]")))
    return F.array_distinct(F.transform(named, F.lower))


def verdict(text: Column) -> Column:
    """A, B or TIE after 'VERDICT:'; null if there is none."""
    return F.nullif(F.upper(F.regexp_extract(text, r"(?i)VERDICT:\s*\*{0,2}(A|B|TIE)\b", 1)), F.lit(""))


def level(text: Column) -> Column:
    """1 to 5 after 'LEVEL:', else a digit by itself in the first 200 characters."""
    named = F.regexp_extract(text, r"(?i)LEVEL:\s*([1-5])", 1)
    return F.coalesce(F.nullif(named, F.lit("")), F.nullif(F.regexp_extract(F.left(text, F.lit(200)), r"\b([1-5])\b", 1), F.lit(""))).cast("int")


def level_score(value: Column) -> Column:
    return (F.least(F.lit(5), F.greatest(F.lit(1), value)) - 1) / 4


def html_text(html: Column) -> Column:
    """Text of a page: scripts, styles and furniture out with what they hold, then tags; white space folded, entities left."""
    bare = F.regexp_replace(html, r"(?is)<(script|style|nav|footer|header|noscript|aside|svg)\b.*?</\1\s*>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"<[^>]*>", " "), r"\s+", " "))


def html_title(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1), r"<[^>]*>", ""))
