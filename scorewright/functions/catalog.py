"""Products, tasks and comments: what their titles, addresses and words say."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from scorewright.functions.text import let

# Words that say too little of a topic by themselves.
AMBIGUOUS = ["book", "books", "guide", "guides", "kit", "kits", "set", "sets", "tool", "tools", "pack", "packs", "case", "cover", "holder", "new", "organizer", "planner", "notebook", "journal", "card", "cards", "starter", "beginners", "complete", "professional", "premium", "management", "market", "home", "light", "black", "white", "best", "top", "good", "great", "free", "easy", "smart", "pro", "mini", "plus", "ultra", "max", "super", "digital", "power", "control", "system", "design", "natural", "organic", "whole", "personal", "stock", "real", "money", "active", "passive", "basic", "general", "standard", "classic", "original", "special", "travel", "world", "life", "care", "health", "water", "food"]
# What makes a product one of sound, and what looks like it but isn't.
AUDIO = r"(?iU)\b(?:headphone|headphones|headset|headsets|earbud|earbuds|earphone|earphones|earpods|airpods|speaker|speakers|soundbar|subwoofer|microphone|microphones|wireless\s*audio|bluetooth\s*audio|gaming\s*audio|audio\s*(?:transmitter|adapter|receiver|jack|cable|interface)|in[- ]?ear|over[- ]?ear|on[- ]?ear|3\.5\s*mm|aux\b|aux\s*cable|walkman|cassette|dac\b|amp\b|audiophile)\b"
NO_AUDIO = r"(?iU)\b(?:piercing|earring|ear\s*hook(?!\s*(?:headphone|earbud|earphone))|ear\s*stud|ear\s*muff|ear\s*plug|ear\s*cushion|hearing\s*aid|speakerphone\s*for\s*car|phone\s*case|phone\s*holder|phone\s*charger|watch\s*charger|laptop\s*stand)\b"
# Words in comments, and the moods that they stand for.
MOODS = {
    "bullish": ["buy", "moon", "long", "bullish", "calls", "yolo", "all in", "rocket"], "bearish": ["short", "puts", "bearish", "crash", "dump", "sell", "rip", "loss"],
    "cautious": ["wait", "careful", "risky", "be careful", "dyor", "not advice"], "mocking": ["lol", "lmao", "smooth brain", "ape", "regard", "🤡", "🤣"],
}


def relevant(title: Column, keywords: Column) -> Column:
    """Whether a product's title fits any of a topic's keywords (an array).

    A keyword fits as a phrase of over five characters, or by two of its telling words (over three letters, not
    AMBIGUOUS) among the title's; a keyword with one telling word by that, if it has six letters or more.
    """
    low = F.lower(F.coalesce(title, F.lit("")))
    words = F.array_distinct(F.regexp_extract_all(low, F.lit("[a-z][a-z0-9]*"), F.lit(0)))

    def fits(keyword: Column) -> Column:
        phrase = F.regexp_replace(F.lower(keyword), r"(?U)^\s+|\s+$", "")
        telling = F.filter(F.split(phrase, r"(?U)\s+"), lambda w: (F.char_length(w) > 3) & ~w.isin(*AMBIGUOUS))
        by_words = let(telling, lambda t: F.when(F.size(t) >= 2, F.size(F.filter(t, lambda w: F.array_contains(words, w))) >= 2).when(F.size(t) == 1, F.array_contains(words, F.get(t, 0)) & (F.char_length(F.get(t, 0)) >= 6)).otherwise(F.lit(False)))
        return ((F.char_length(phrase) > 5) & F.contains(low, phrase)) | by_words

    return F.exists(F.coalesce(keywords, F.array().cast("array<string>")), fits)


def audio(address: Column, title: Column) -> Column:
    """Why a product is or isn't one of sound: negative_filter (what was found), audio_positive or not_audio_keyword."""
    both = F.concat(F.coalesce(address, F.lit("")), F.lit(" "), F.coalesce(title, F.lit("")))
    against = F.regexp_extract(both, NO_AUDIO, 0)
    return F.when(against != "", F.concat(F.lit("negative_filter ("), against, F.lit(")"))).when(both.rlike(AUDIO), "audio_positive").otherwise("not_audio_keyword")


def brand(title: Column) -> Column:
    """The capitalised word of three to 21 letters and digits that a title begins with, else null."""
    return F.nullif(F.regexp_extract(title, r"\A([A-Z][A-Za-z0-9]{2,20})\b", 1), F.lit(""))


def product_id(address: Column) -> Column:
    """The last part of a product's address, without .html; null for other addresses."""
    return F.nullif(F.regexp_extract(address, r"/([a-z0-9-]+)\.html\n?\z", 1), F.lit(""))


def budget(intent: Column) -> Column:
    """The first amount of two to four digits behind a dollar sign, if it is 50 or more, else null."""
    amount = F.nullif(F.regexp_extract(intent, r"(?U)\$\s*(\d{2,4})", 1), F.lit("")).cast("double")
    return F.when(amount >= 50, amount)


def seed(task: Column) -> Column:
    """A number of 32 bits from the SHA-256 of a task's id."""
    return F.conv(F.left(F.sha2(task.cast("binary"), 256), F.lit(8)), 16, 10).cast("long")


def mood(comments: Column) -> Column:
    """What most of an array of comments stand for, ties to the name that comes last; `no clear sentiment` if none has any such word."""
    says = lambda words: lambda c: reduce(lambda a, w: a | F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(w)), words, F.lit(False))
    counts = [F.struct(F.coalesce(F.size(F.filter(comments, says(words))), F.lit(0)).alias("n"), F.lit(name).alias("name")) for name, words in MOODS.items()]
    return let(F.array_max(F.array(*counts)), lambda m: F.when(m["n"] > 0, m["name"]).otherwise("no clear sentiment"))


def rows_of(text: Column, separator: str) -> Column:
    """Lines of a text as arrays of their cells; blank ones are left out."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"), lambda line: F.regexp_replace(line, r"(?U)^\s+|\s+$", ""))
    return F.transform(F.filter(lines, lambda line: line != ""), lambda line: F.split(line, F.lit(rf"\Q{separator}\E"), F.lit(-1)))
