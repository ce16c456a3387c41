"""Fingerprints, pieces, token files, packing: against brute force or the libraries themselves."""

from __future__ import annotations

import hashlib
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import SF

from scorewright.llm import fingerprints, packing, pieces, queries, token_files
from scorewright.llm.common import shared_dir

from .conftest import EDGE


def canonical(text):
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text or "").casefold())
    return " ".join(folded.split())


def test_op1_whole_table(spark, texts):
    found = {r.doc_id: r for r in queries.op1_fingerprints(spark, SF).collect()}
    assert sorted(found) == [i for i, _ in texts]
    down = texts[::-1]
    by_print, by_text = defaultdict(set), defaultdict(set)
    for (i, text), (_, after) in zip(down, [*down[1:], down[0]], strict=True):
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        row = found[i]
        assert (row.n_chars, row.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert row.near_edited == (canonical(text) == canonical(edited)) and row.near_next == (canonical(text) == canonical(after))
        by_print[row.fingerprint].add(i)
        by_text[canonical(text)].add(i)
    assert sorted(map(sorted, by_print.values())) == sorted(map(sorted, by_text.values()))
    assert all(found[i].group_id == min(group) for group in by_text.values() for i in group)


def test_op1_edges(edge, empty):
    rows = fingerprints.spliced(edge).collect()
    assert len(rows) == len(set(EDGE))
    prints = {r.doc_id: r.fingerprint for r in rows}
    assert prints[1] == prints[2] and prints[3] == prints[4] == prints[5] and prints[6] == prints[7] and prints[8] == prints[9] and prints[12] == prints[13] != prints[1]
    assert fingerprints.spliced(empty).count() == 0 and fingerprints.exact_groups(empty).count() == 0


def test_op1_bytes_decide(spark):
    """Texts that clash under a digest are told apart by their bytes."""
    rows = spark.createDataFrame([(1, 1, "f", "a"), (2, 2, "f", "b"), (3, 3, "f", "a"), (4, 4, "g", "c"), (5, 5, "g", "c")], "doc_id long, tag long, fingerprint string, c string")
    assert {r.doc_id: r.group_id for r in fingerprints.grouped_by_bytes(rows).collect()} == {1: 1, 2: 2, 3: 1, 4: 4, 5: 4}


def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)


def test_op2_whole_table(spark, texts):
    model = library()
    found = {r.doc_id: r for r in queries.op2_pieces(spark, SF).collect()}
    for i, text in texts:
        ids = np.array(model.encode(text), "<u4")
        assert (found[i].n_pieces, found[i].ids_crc32) == (len(ids), zlib.crc32(ids.tobytes())), i
        assert found[i].decoded_sha256 == hashlib.sha256(model.decode(model.encode(text)).encode()).hexdigest()


def test_op2_random_texts(rng):
    import pyarrow as pa

    model, ours = library(), pieces.PieceEncoder(queries.PIECES)
    some = [" ".join(rng.choice(["the", "of", "Ab", "x9", "--", "ing", "été", "日本", "😀", "...", "\"", "un", "$5.30", "\n", ""]) + rng.choice(["", ",", "s", "ed", ".\n"]) for _ in range(rng.randrange(40))) for _ in range(400)]
    some += [t for _, t in EDGE if t is not None and len(t) < 1000] + ["".join(rng.choice("abe nt.i") for _ in range(60)) for _ in range(400)]
    ids, bounds = ours.encode(pa.array(some))
    for text, a, b in zip(some, bounds[:-1], bounds[1:], strict=True):
        assert ids[a:b].tolist() == model.encode(text), repr(text)
        assert ours.decode(ids[a:b].tolist()) == model.decode(model.encode(text))


def test_op2_edges(edge, empty):
    coded = pieces.decode_pieces(pieces.encode_pieces(edge, queries.PIECES), queries.PIECES)
    assert coded.count() == len(EDGE) and set(edge.columns) < set(coded.columns)
    assert all(r.decoded == r.text for r in coded.where("doc_id < 8 and text is not null and doc_id <> 5").collect())
    assert pieces.recode_pieces(empty, queries.PIECES).count() == 0


def test_op2_long_runs_of_spaces():
    """As the library, and in time that does not grow with the square of the run."""
    import time

    import pyarrow as pa

    model, ours = library(), pieces.PieceEncoder(queries.PIECES)
    for text in (" " * 1_000_000, "a" + " " * 1001 + "b", " " * 77 + "x  y   z", "  ", "\n  \n", "ab" * 3000):
        began = time.time()
        assert ours.encode(pa.array([text]))[0].tolist() == model.encode(text)
        assert time.time() - began < 60


def test_op1_folds_case_and_is_native(spark):
    """Full case folding, also where it is longer than the letter; no Python in the plan."""
    from pyspark.sql import functions as F

    rows = [("Straße", "STRASSE"), ("ŉ", "ʼn"), ("ΌΣΟΣ", "όσος"), ("ǅ", "ǆ"), ("ﬃ", "FFI"), ("İ", "i̇"), ("ᾳ", "ΑΙ"), ("É", "e\u0301"), ("a\u00a0b", "A  B")]
    df = spark.createDataFrame(rows, "a string, b string").select(fingerprints.canonical(F.col("a")).alias("a"), fingerprints.canonical(F.col("b")).alias("b"))
    assert [(r.a, r.b) for r in df.collect()] == [(canonical(a), canonical(b)) for a, b in rows] and df.where("a != b").count() == 0
    plan = fingerprints.spliced(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in ("Python", "Arrow", "Pandas") if x in plan]


def test_op1_hot_group(spark):
    """One text in a third of all rows and more goes another way through the joins, to the same result."""
    rows = [(i, "the same text" if i % 3 else f"text number {i}") for i in range(4500)]
    found = {r.doc_id: r for r in fingerprints.spliced(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(found) == len(rows) and {found[i].group_id for i, _ in rows if i % 3} == {1} and all(found[i].group_id == i for i, _ in rows if not i % 3)
    assert len({r.fingerprint for r in found.values()}) == 1501 and all(found[i].near_next == (i % 3 == 2) for i, _ in rows[1:])


def tokens(text, end):
    from tokenizers import Tokenizer

    tokens.model = getattr(tokens, "model", None) or Tokenizer.from_file(queries.WORD_BPE)
    return np.array([*tokens.model.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_op3_whole_table(spark, texts):
    found, start = {r.doc_id: r for r in queries.op3_token_files(spark, SF).collect()}, 0
    for i, text in texts:
        ids = tokens(text, 2)
        assert (found[i].start, found[i].n_tokens, found[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


@pytest.mark.parametrize("layout", ["byte", "bit"])
def test_op3_planes(layout):
    for n in (0, 1, 7, 8, 65_536):
        ids = np.random.default_rng(n).integers(0, 2**32, n, dtype=np.uint32)
        assert (token_files.from_planes(token_files.to_planes(ids, layout) if n else [], n, layout) == ids).all()


@pytest.mark.parametrize("layout", ["byte", "bit"])
def test_op3_edges(spark, edge, empty, layout):
    path = shared_dir(spark)
    token_files.write_ids(edge, path, queries.WORD_BPE, chunk_ids=100, layout=layout)
    found = token_files.summarise(token_files.read_ids(spark, path)).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in found) == Counter((i, len(tokens(t, 2)), zlib.crc32(tokens(t, 2).tobytes())) for i, t in EDGE)
    ordered = sorted(found, key=lambda r: r.start)
    assert [r.start for r in ordered] == [0, *np.cumsum([r.n_tokens for r in ordered])[:-1].tolist()]
    path = shared_dir(spark)
    token_files.write_ids(empty, path, queries.WORD_BPE)
    assert token_files.summarise(token_files.read_ids(spark, path)).count() == 0


def test_crc_of_parts():
    data = bytes(range(256)) * 5
    assert token_files.crc32_of_parts([(zlib.crc32(data[:100]), 100), (zlib.crc32(data[100:101]), 1), (zlib.crc32(data[101:]), len(data) - 101)]) == zlib.crc32(data)


def assert_packed(rows, expected, window=2048, padding=0.02):
    """Each id in one piece, sequences gapless and at most a window, and little padding."""
    parts, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r.length == len(r.ids) // 4
        parts[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(parts) == set(expected)
    for i, ids in expected.items():
        ordered = sorted(parts[i], key=lambda r: r.start)
        assert b"".join(bytes(r.ids) for r in ordered) == ids and [r.start for r in ordered] == [0, *np.cumsum([r.length for r in ordered])[:-1].tolist()]
        assert {r.doc_tokens for r in ordered} == {len(ids) // 4}
    sizes = []
    for s in sequences.values():
        s.sort()
        assert [o for o, _ in s] == [0, *np.cumsum([n for _, n in s])[:-1].tolist()]
        sizes.append(sum(n for _, n in s))
    assert max(sizes) <= window
    padded = sum(n if n & (n - 1) == 0 else window for n in sizes)
    assert padded <= (1 + padding) * sum(sizes)


def test_op4_whole_table(docs, texts):
    rows = packing.pack(docs, queries.WORD_BPE, 2048, 1).collect()
    assert_packed(rows, {i: tokens(t, 1).tobytes() for i, t in texts})


def test_op4_edges(edge, empty):
    single = edge.where("doc_id is not null").dropDuplicates(["doc_id"])
    assert_packed(packing.pack(single, queries.WORD_BPE, 2048, 1).collect(), {i: tokens(t, 1).tobytes() for i, t in EDGE if i is not None}, padding=0.3)
    assert packing.pack(edge, queries.WORD_BPE, 2048, 1).groupBy().sum("length").first()[0] == sum(len(tokens(t, 1)) for _, t in EDGE)
    assert packing.pack(empty, queries.WORD_BPE).count() == 0


def test_op4_tightest_window(rng):
    """The tree finds what a scan of all open windows finds."""
    for _ in range(30):
        lengths, size = [rng.randrange(1, 51) for _ in range(rng.randrange(80))], 50
        rooms, want = [], []
        for piece in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
            fit = min((r for r in rooms if r >= lengths[piece]), default=None)
            if fit is not None:
                rooms.remove(fit)
            rooms.append((size if fit is None else fit) - lengths[piece])
            want.append(fit)
        windows = packing.best_fit(lengths, size)
        assert sorted(size - sum(lengths[i] for i in w) for w in windows) == sorted(rooms) and sorted(i for w in windows for i in w) == list(range(len(lengths)))


def test_op4_fills_windows(spark):
    """Documents of a little over half a window: no sequence is short but at the end of a task."""
    words = "word " * 1099
    rows = packing.pack(spark.createDataFrame([(i, words.strip()) for i in range(1000)], "doc_id long, text string").coalesce(2), queries.WORD_BPE).collect()
    n = len(tokens(words.strip(), 1))
    assert_packed(rows, {i: tokens(words.strip(), 1).tobytes() for i in range(1000)}, padding=0.01)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.sequence_id] += r.length
    assert 1024 < n < 2048 and sum(s < 512 for s in sizes.values()) <= 2 * 11


def test_op4_filled_by_hand(rng):
    """Every piece is there whole, in windows that are filled or left over."""
    for _ in range(50):
        size, gap = 64, rng.randrange(8)
        windows = [[(i, 0, rng.randrange(1, size // k + 1)) for i in range(j * 3, j * 3 + k)] for j, k in enumerate(rng.randrange(1, 4) for _ in range(rng.randrange(12)))]
        done, left = packing.filled(windows, size, gap)
        assert all(size - gap <= sum(n for _, _, n in w) <= size for w in done) and sum(n for _, _, n in left) < size
        want = sorted((name, k) for w in windows for name, start, n in w for k in range(start, start + n))
        assert sorted((name, k) for w in [*done, left] for name, start, n in w for k in range(start, start + n)) == want


def test_encoder_meets_words_once_in_lower_case_without_marks():
    """Ids are the tokenizer's own, and words with letters up to ÿ that differ in case and closing marks are encoded once."""
    import pyarrow as pa
    from scorewright.llm.tokens import TextEncoder

    coder = TextEncoder(queries.WORD_BPE)
    texts = ["Ciónrr. ciónrr ÁÉÿ! áéÿ), CIÓNRR?", None, "", " \n ", "İ. ΣΑΣ. σας <|endoftext|>, a|B. 1. x1. it's IT'S. ß. µ, é. É 日本. ª. \x85A \xa0b. ...", "x" * 100 + ". Dž. ŉ, Å\t\x0bB."]
    ids, bounds = coder.encode(pa.array(texts))
    for text, a, b in zip(texts, bounds, bounds[1:], strict=False):
        assert ids[a:b].tolist() == coder.model.encode(text or "", add_special_tokens=False).ids, text
    assert coder.by_word
    assert [w for w in coder.memo if "rr" in w.lower()] == ["ciónrr"]
    again, _ = coder.encode(pa.array(texts))
    assert (again == ids).all()
