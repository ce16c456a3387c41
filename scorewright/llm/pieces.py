"""SentencePiece ids by suffix-array matching: all occurrences of all pieces in a batch become edges, which are then relaxed."""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from scorewright.llm.common import ragged, slices

SPACE = "▁"
#: Chunks kept with their ids in a Python worker (in two generations), and the longest that is kept.
MEMO_CHUNKS, MEMO_CHARS = 400_000, 64
#: Bytes of text (or ids) that a worker takes at once.
SLICE = 2 << 20
#: Chunks in one suffix array: it bounds what its edges take.
BATCH_CHUNKS = 25_000
#: Pairs of pieces whose seam is kept.
MEMO_SEAMS = 2_000_000
ENDS = ".,!?;:*$%&#|)\"'"
_loaded: dict[str, PieceEncoder] = {}


def suffix_array(text: np.ndarray, depth: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, int]:
    """Positions of `text` (code points) in the order of their next `depth` characters.

    Also the characters packed into whole numbers that give this order (as many to a number as fit), in that order,
    the characters that occur, whose places from 1 on are packed, and how many a number has.
    """
    letters, codes = np.unique(text, return_inverse=True)
    bits = int(len(letters)).bit_length()
    width = 62 // bits
    padded = np.concatenate([codes + 1, np.zeros(depth + width, np.int64)])
    first = np.zeros(len(text), np.int64)
    for i in range(width):
        first = first << bits | padded[i : i + len(text)]
    numbers = [np.concatenate([first[at:], np.zeros(min(at, len(text)), np.int64)])[: len(text)] for at in range(0, depth, width)]
    order = np.lexsort(numbers[::-1])
    return order, [n[order] for n in numbers], letters, width


class PieceEncoder:
    """Encodes and decodes as the library does with a BPE model with byte fallback and no normalisation.

    A text is cut where no piece reaches across: before runs of spaces, at line ends, before closing marks. Distinct
    chunks of a batch are put one after the other; a suffix array finds each piece's occurrences by binary search;
    these are edges from where a piece begins to where it ends. Relaxing them in order of their ends keeps for each
    position the one piece that a merge order can end there: one that starts where another such piece ended, and with
    whose characters merging would not have gone on across the seam. This path is the library's segmentation. Runs of
    several spaces, whose pieces share one score, are merged step by step.
    """

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(size)]
        self.bytes_at = next(i for i in range(size) if model.is_byte(i))
        plain = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.ids = {self.pieces[i]: i for i in plain}
        self.score = {self.pieces[i]: model.get_score(i) for i in plain}
        self.raw = [bytes([i - self.bytes_at]) if model.is_byte(i) else b"" if model.is_control(i) else self.pieces[i].replace(SPACE, " ").encode() for i in range(size)]
        self.raw[model.unk_id()] = b" \xe2\x81\x87 "
        self.joined = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        # Only pieces that merging makes of their own characters can be part of a result.
        made = sorted(p for p in self.ids if SPACE * 2 not in p and self.merge(p) == [p])
        self.depth = max(map(len, made))
        self.made_ids = np.array([self.ids[p] for p in made], np.int64)
        self.made_len = np.array([len(p) for p in made], np.int64)
        self.made = np.zeros((len(made), self.depth), np.int32)
        for row, p in zip(self.made, made, strict=True):
            row[: len(p)] = [ord(c) for c in p]
        self.memo: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.seams = np.zeros(0, np.int64), np.zeros(0, bool)

    def merge(self, text: str) -> list[str]:
        """The text's symbols after merging the best pair, leftmost first, until none is a piece."""
        parts, score, n = list(text), self.score, len(text)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        # Pairs by score and place, with their length: a pair one of whose symbols has since changed has another one.
        waiting = [(-s, i, 2) for i in range(n - 1) if (s := score.get(text[i : i + 2])) is not None]
        heapify(waiting)
        while waiting:
            _, i, size = heappop(waiting)
            j = after[i]
            if not parts[i] or j >= n or len(parts[i]) + len(parts[j]) != size:
                continue
            parts[i], parts[j] = parts[i] + parts[j], ""
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < n and (s := score.get(parts[left] + parts[right])) is not None:
                    heappush(waiting, (-s, left, len(parts[left]) + len(parts[right])))
        return [p for p in parts if p]

    def _of_parts(self, parts: list[str]) -> list[int]:
        return [i for p in parts for i in ([self.ids[p]] if p in self.ids else [self.bytes_at + b for b in p.encode()])]

    def _stay_apart(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Whether merging leaves each two neighbouring pieces as they are."""
        size = len(self.pieces)
        known, apart = self.seams
        wanted = first * size + second
        at = np.searchsorted(known, wanted)
        fresh = np.ones(len(wanted), bool) if not len(known) else known[np.minimum(at, len(known) - 1)] != wanted
        if fresh.any():
            if len(known) > MEMO_SEAMS:
                self.seams = known[:0], apart[:0]
                return self._stay_apart(first, second)
            names, found = np.unique(wanted[fresh]), []
            for a, b in zip((names // size).tolist(), (names % size).tolist(), strict=True):
                left, right = self.pieces[a], self.pieces[b]
                found.append(left[-1] + right[0] not in self.joined or self.merge(left + right) == [left, right])
            places = np.searchsorted(known, names)
            known, apart = self.seams = np.insert(known, places, names), np.insert(apart, places, np.array(found, bool))
            at = np.searchsorted(known, wanted)
        return apart[at]

    def _occurrences(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, length and id of every occurrence of every piece in the text (code points, chunks apart by zeros)."""
        order, numbers, letters, width = suffix_array(text, self.depth)
        bits = int(len(letters)).bit_length()
        at = np.searchsorted(letters, self.made)
        known = letters[np.minimum(at, len(letters) - 1)] == self.made
        inside = np.arange(self.depth) < self.made_len[:, None]
        usable = np.flatnonzero((known | ~inside).all(axis=1))  # pieces whose characters all occur
        codes = np.where(inside, at + 1, 0)[usable]
        spans, ids = self.made_len[usable], self.made_ids[usable]
        codes = np.concatenate([codes, np.zeros((len(codes), -self.depth % width), np.int64)], axis=1)

        def packed(fill: int) -> np.ndarray:
            """The pieces' numbers, what is beyond their ends as `fill`: their least or greatest suffix."""
            filled = np.where(np.arange(codes.shape[1]) < spans[:, None], codes, fill)
            out = np.zeros((len(codes), len(numbers)), np.int64)
            for i in range(codes.shape[1]):
                out[:, i // width] = out[:, i // width] << bits | filled[:, i]
            return out

        def bound(above: bool) -> np.ndarray:
            """Binary search for where each piece's suffixes begin, or with `above` where they have ended."""
            wanted = packed((1 << bits) - 1 if above else 0)
            found = np.searchsorted(numbers[0], wanted[:, 0], side="right" if above else "left")
            long = np.flatnonzero(spans > width)
            low = np.searchsorted(numbers[0], wanted[long, 0], side="left")
            high = np.searchsorted(numbers[0], wanted[long, 0], side="right")
            while (here := np.flatnonzero(low < high)).size:  # among equal first numbers, by the others
                middle = (low[here] + high[here]) // 2
                right = np.full(len(here), above)
                for number, want in zip(reversed(numbers[1:]), reversed(range(1, len(numbers))), strict=True):
                    a, b = number[middle], wanted[long[here], want]
                    right = np.where(a == b, right, a < b)
                low[here] = np.where(right, middle + 1, low[here])
                high[here] = np.where(right, high[here], middle)
            found[long] = low
            return found

        lower = bound(False)
        counts = bound(True) - lower
        starts = order[ragged(lower, counts)]
        which = np.repeat(np.arange(len(usable)), counts)
        return starts, spans[which], ids[which]

    def _match(self, chunks: list[str]) -> list[list[int]]:
        """Ids of distinct chunks without runs of spaces."""
        size = len(self.pieces)
        text = np.frombuffer("".join(f"{c}\0" for c in chunks).encode("utf-32-le"), np.int32)
        lengths = np.fromiter(map(len, chunks), np.int64, len(chunks))
        first = np.cumsum(lengths + 1) - lengths - 1
        origin = np.repeat(first, lengths + 1)
        starts, spans, ids = self._occurrences(text)
        alone = np.ones(len(text), bool)  # characters that aren't pieces: edges of one, named `size`
        alone[starts[spans == 1]] = False
        alone &= text != 0
        lone = np.flatnonzero(alone)
        starts, spans, ids = np.concatenate([starts, lone]), np.concatenate([spans, np.ones(len(lone), np.int64)]), np.concatenate([ids, np.full(len(lone), size)])
        ends = starts + spans
        reach = ends - origin[starts]
        order = np.argsort(reach, kind="stable")
        starts, ends, ids, reach = starts[order], ends[order], ids[order], reach[order]
        last, came = np.full(len(text) + 1, -1, np.int64), np.zeros(len(text) + 1, np.int64)
        steps = np.flatnonzero(np.concatenate([[True], reach[1:] != reach[:-1]])) if len(reach) else np.zeros(0, np.int64)
        for a, b in zip(steps, np.append(steps[1:], len(reach)), strict=True):
            s, e, p = starts[a:b], ends[a:b], ids[a:b]
            opening = s == origin[s]
            before = last[s]
            ok = opening | (before == size) | ((before >= 0) & (p == size))
            test = np.flatnonzero(~ok & (before >= 0))
            if len(test):
                ok[test] = self._stay_apart(before[test], p[test])
            last[e[ok]], came[e[ok]] = p[ok], s[ok]
        found: list[list[int]] = [[] for _ in chunks]
        last, came = last.tolist(), came.tolist()
        for out, a, n, chunk in zip(found, first.tolist(), lengths.tolist(), chunks, strict=True):
            at = a + n
            while at > a:
                if last[at] == size:
                    out.extend(self.bytes_at + b for b in reversed(chunk[at - 1 - a].encode()))
                else:
                    out.append(last[at])
                at = came[at]
            out.reverse()
        return found

    def _chunks(self, chunks: list[str]) -> list[bytes]:
        """The ids of each chunk, as little-endian unsigned 32 bit."""
        memo, old = self.memo, self.old
        if missing := [c for c in dict.fromkeys(chunks) if c not in memo]:
            if len(memo) + len(missing) > MEMO_CHUNKS // 2:
                old, memo = self.old, self.memo = memo, {}
                missing = list(dict.fromkeys(chunks))
            fresh = {c: old[c] for c in missing if c in old}
            plain = []
            for c in missing:
                if c in fresh:
                    continue
                if SPACE * 2 in c or "\0" in c:
                    fresh[c] = array("I", self._of_parts(self.merge(c))).tobytes()
                else:
                    plain.append(c)
            for at in range(0, len(plain), BATCH_CHUNKS):
                part = plain[at : at + BATCH_CHUNKS]
                fresh.update(zip(part, (array("I", i).tobytes() for i in self._match(part)), strict=True))
            memo.update((c, i) for c, i in fresh.items() if len(c) <= MEMO_CHARS)
            return [i if (i := memo.get(c)) is not None else fresh[c] for c in chunks]
        return [memo[c] for c in chunks]

    def _ids(self, words: list[str]) -> list[bytes]:
        """The ids of words with their spaces before them; lines and closing marks are looked up by themselves."""
        cut: list[list[str]] = []
        for word in words:
            lines, out = word.split("\n") if "\n" in word else (word,), []
            for i, line in enumerate(lines):
                if i:
                    out.append("\n")
                stem = line.rstrip(ENDS)
                if stem and len(stem) < len(line) and stem[-1] + line[len(stem)] not in self.joined:
                    out += [stem, line[len(stem) :]]
                elif line:
                    out.append(line)
            cut.append(out)
        asked = list(dict.fromkeys(c for out in cut for c in out))
        known = dict(zip(asked, self._chunks(asked), strict=True))
        return [known[out[0]] if len(out) == 1 else b"".join([known[c] for c in out]) for out in cut]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other (unsigned 32 bit), and where each text's begin (one more than texts); null texts are empty."""
        texts = pc.replace_substring(pc.fill_null(texts, ""), " ", SPACE)
        odd = pc.or_(pc.match_substring(texts, SPACE * 2), pc.or_(pc.starts_with(texts, SPACE), pc.or_(pc.ends_with(texts, SPACE), pc.equal(texts, ""))))
        if pc.any(odd).as_py():
            split = [re.findall(f"{SPACE}+[^{SPACE}]*", SPACE + t) if t else [] for t in texts.to_pylist()]
            parts = pa.array(split, pa.list_(pa.string()))
        else:
            parts = pc.split_pattern(texts, SPACE)
        coded = pc.dictionary_encode(parts.flatten())
        words = coded.dictionary.to_pylist()
        known = self._ids(words if pc.any(odd).as_py() else [SPACE + w for w in words])
        lengths = np.fromiter(map(len, known), np.int64, len(known)) // 4
        flat = np.frombuffer(b"".join(known), np.uint32)
        codes = coded.indices.to_numpy()
        per_word = lengths[codes]
        ids = flat[ragged((np.cumsum(lengths) - lengths)[codes], per_word)]
        bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(parts).to_numpy())])
        return ids, np.concatenate([[0], np.cumsum(per_word)])[bounds]

    def decode(self, ids: list[int]) -> str:
        """The text of ids; of the first piece, the space before it is not part of it."""
        data = b"".join(map(self.raw.__getitem__, ids))
        return (data[1:] if data[:1] == b" " else data).decode(errors="replace")


def encoder(path: str) -> PieceEncoder:
    if path not in _loaded:
        _loaded[path] = PieceEncoder(path)
    return _loaded[path]


def _mapped(df: DataFrame, column: str, fields: list[T.StructField], work: Callable[[pa.Array], list[pa.Array]]) -> DataFrame:
    """df with further columns, which `work` makes of slices of one; columns so named are replaced."""
    names = [f.name for f in fields]
    kept = df.drop(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column, SLICE):
            yield pa.RecordBatch.from_arrays([*batch.columns, *work(batch.column(column))], names=[*batch.schema.names, *names])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, *fields]))


def _coded(model: str, texts: pa.Array) -> list[bytes]:
    ids, bounds = encoder(model).encode(texts)
    raw = ids.astype("<u4").tobytes()
    return [raw[4 * a : 4 * b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def _decoded(model: str, coded: list[bytes | None]) -> pa.Array:
    decode = encoder(model).decode
    return pa.array([None if b is None else decode(np.frombuffer(b, "<u4").tolist()) for b in coded], pa.string())


def encode_pieces(df: DataFrame, model: str, text_column: str = "text", ids_column: str = "piece_ids") -> DataFrame:
    """df with the ids of each text's pieces (little-endian unsigned 32 bit), in a column that replaces one so named.

    Null and empty texts have no ids; every row is kept; an empty table stays empty.
    """
    return _mapped(df, text_column, [T.StructField(ids_column, T.BinaryType())], lambda texts: [pa.array(_coded(model, texts), pa.binary())])


def decode_pieces(df: DataFrame, model: str, ids_column: str = "piece_ids", text_column: str = "decoded") -> DataFrame:
    """df with the text of each row's ids in a column that replaces one so named; null ids give null."""
    return _mapped(df, ids_column, [T.StructField(text_column, T.StringType())], lambda coded: [_decoded(model, coded.to_pylist())])


def recode_pieces(df: DataFrame, model: str, text_column: str = "text", ids_column: str = "piece_ids", decoded_column: str = "decoded") -> DataFrame:
    """encode_pieces() and decode_pieces() of its ids in one pass, by one Python worker a task."""

    def work(texts: pa.Array) -> list[pa.Array]:
        coded = _coded(model, texts)
        return [pa.array(coded, pa.binary()), _decoded(model, coded)]

    return _mapped(df, text_column, [T.StructField(ids_column, T.BinaryType()), T.StructField(decoded_column, T.StringType())], work)
