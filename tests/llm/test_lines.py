"""Line dedup: chunks by brute force on every repeated passage, odd rows, shifts, and recall on passages of over 50 words."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from conftest import SF
from scorewright.llm import line_dedup, queries

from .conftest import EDGE


def passages(text):
    """Runs of lines that count: (first, last line, their full lines), by restating the rule."""
    lines = text.split("\n")
    full = [n for n, x in enumerate(lines) if x.encode().strip()]
    words = [len(lines[n].encode().split()) for n in full]
    chunks = []
    for k in range(len(full)):
        if k:
            pair = xxhash.xxh64_intdigest(lines[full[k - 1]].encode()) * line_dedup._MULTIPLIER + xxhash.xxh64_intdigest(lines[full[k]].encode())
            apart = ((pair * line_dedup._MULTIPLIER) % 2**64 >> 32) % 3 == 0
        if not k or apart or len(chunks[-1]) >= line_dedup.MOST:
            chunks.append([])
        chunks[-1].append(k)
    runs = [c for c in chunks if len(c) > 1 and sum(words[k] for k in c) >= 20]
    for k in range(len(full)):
        long = next((m for m in range(k, len(full)) if sum(words[k : m + 1]) >= 50), None)
        if long is not None:
            runs.append(list(range(k, long + 1)))
    return [(full[r[0]], full[r[-1]], tuple(lines[full[k]] for k in r)) for r in runs]


def without_repeats(rows):
    """(id, text) -> text without passages that stood before, and how many lines went."""
    first, out = {}, {}
    ordered = sorted({(i if i is not None else 1 << 62, t or "") for i, t in rows}, key=lambda r: (r[0], xxhash.xxh64_intdigest(r[1].encode(), 42) - (1 << 64) * (xxhash.xxh64_intdigest(r[1].encode(), 42) >> 63)))
    for i, text in ordered:
        lines, gone = text.split("\n"), set()
        for a, b, what in sorted(passages(text)):
            if first.setdefault(what, (i, text, a)) != (i, text, a):
                gone.update(range(a, b + 1))
        out[i, text] = ("\n".join(x for n, x in enumerate(lines) if n not in gone), len(gone))
    return out


def test_op10_whole_table(spark, texts):
    found = {r.doc_id: r for r in queries.op10_line_dedup(spark, SF).collect()}
    want = without_repeats(texts)
    assert any(gone for _, gone in want.values())
    for i, text in texts:
        new, gone = want[i, text]
        assert (found[i].removed_lines, found[i].lines, found[i].text_sha256) == (gone, text.count("\n") + 1, hashlib.sha256(new.encode()).hexdigest())


def test_op10_no_line_is_lost(spark, texts):
    found = line_dedup.drop_repeated_lines(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert {x for _, t in texts for x in t.split("\n") if x.strip()} == {x for r in found for x in r.text.split("\n") if x.strip()}


@pytest.mark.parametrize("words", [1, 2, 3, 5, 8, 13, 26, 51, 90])
def test_op10_recall(spark, words):
    """Of passages of over 50 words, in lines of so many words, at least 0.9 lose lines wherever they stand, and most lines go."""
    rng = random.Random(words)
    count, rows = 51 // words + 1, []
    for n in range(60):
        passage = [" ".join(f"w{rng.randrange(99999)}" for _ in range(words)) for _ in range(count)]
        for copy in range(2):
            own = [[f"own {n} {copy} {k} {rng.random()}" for k in range(rng.randrange(0, 4))] for _ in range(2)]
            rows.append((copy * 1000 + n, own[0] + passage + own[1], count, own[0] + own[1]))
    found = {r.doc_id: r for r in line_dedup.drop_repeated_lines(spark.createDataFrame([(r[0], "\n".join(r[1])) for r in rows], "doc_id long, text string")).collect()}
    assert all(found[i].text == "\n".join(lines) for i, lines, _, _ in rows if i < 1000)
    later = [r for r in rows if r[0] >= 1000]
    caught = [found[i].removed_lines for i, _, _, _ in later]
    assert sum(n > 0 for n in caught) >= 0.9 * len(later) and sum(caught) >= 0.6 * count * len(later)
    assert all(Counter(own) <= Counter(found[i].text.split("\n")) for i, _, _, own in later)
    if words >= line_dedup.CHUNK_WORDS:
        assert all(n == count for n in caught)


def test_op10_single_lines_stay(spark):
    """A repeated line of under 50 words between own lines is no passage; of 50 words it is."""
    short, long = " ".join(["again"] * 49), " ".join(["again"] * 50)
    rows = [(i, f"own {i}\n{short if i < 5 else long}\nend {i}") for i in range(10)]
    found = {r.doc_id: r.removed_lines for r in line_dedup.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {i: int(i > 5) for i in range(10)}


def test_op10_shifted_boundaries(rng):
    """Chunks after an inserted line are the same again; fewer than half of all have one line."""
    hashes = [rng.getrandbits(64) for _ in range(4000)]
    ends = line_dedup.chunk_ends(hashes)
    later = [e - 1 for e in line_dedup.chunk_ends([rng.getrandbits(64), *hashes])]
    assert ends[-1] == 4000 and set(ends) <= set(later)
    sizes = np.diff([0, *ends])
    assert (sizes == 1).mean() < 0.4 and 2.7 < sizes.mean() < 3.3
    assert line_dedup.chunk_ends([]) == [] and max(np.diff([0, *line_dedup.chunk_ends([5] * 1000)])) <= line_dedup.MOST


def test_op10_chunks_in_the_table(texts):
    """The rolling hash decides in real documents too: fewer than half of all chunks have one line."""
    sizes = []
    for _, text in texts:
        full = [x.encode() for x in text.split("\n") if x.encode().strip()]
        sizes += np.diff([0, *line_dedup.chunk_ends([xxhash.xxh64_intdigest(x) for x in full])]).tolist()
    assert np.mean(np.array(sizes) == 1) < 0.5


def test_op10_common_pairs_stay(spark):
    """Short lines that many documents share, two and three in a row, are no passage; a chunk of 20 words is, where both documents cut it out."""
    rows = [(i, f"own {i}\nDear reader,\nthank you for coming here today\nown {i * i}\nAll rights reserved.\nNo warranty.\nContact us.\nend {i}") for i in range(40)]
    found = line_dedup.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.text) for r in found} == set(rows)
    rng, caught = random.Random(1), 0
    for n in range(200):
        lines = [" ".join(f"w{rng.random()}" for _ in range(7)) for _ in range(9)]
        ends = line_dedup.chunk_ends([xxhash.xxh64_intdigest(x.encode()) for x in lines])
        caught += any(b - a > 2 for a, b in zip([0, *ends], ends, strict=False))
    assert caught > 150


def test_op10_hot_passage(spark):
    """A passage in all rows, more than go through one task, leaves its first occurrence."""
    passage = "the license says this and that " * 5 + "\nand it goes on for another line of words" * 3
    rows = [(i, f"own line {i}\n{passage}\nlast line {i * i}") for i in range(3000)]
    found = {r.doc_id: r.text for r in line_dedup.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {i: t if i == 0 else f"own line {i}\nlast line {i * i}" for i, t in rows}


def test_op10_edges(edge, empty):
    found = line_dedup.drop_repeated_lines(edge)
    rows = found.collect()
    assert len(rows) == len(EDGE) and set(edge.columns) <= set(found.columns)
    want = without_repeats(EDGE)
    assert Counter((r.doc_id, r.text or "") for r in rows) == Counter((i, want[i if i is not None else 1 << 62, t or ""][0]) for i, t in EDGE)
    assert line_dedup.drop_repeated_lines(empty).count() == 0
