"""Token ids of whole texts by the `tokenizers` library, each distinct word encoded once."""

from __future__ import annotations

import os
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from scorewright.llm.common import ragged

#: Words kept with their ids in a Python worker (in two generations), and the longest word that is kept.
MEMO_WORDS, MEMO_CHARS = 800_000, 64
#: Words without the mark of special tokens and without letters that depend on those beside them, in lower case or composed.
PLAIN = r"^[\x00-{}~\x{7f}-\x{ff}]*$"
#: Words that end in marks which are never joined with a letter before them (but in one that lower case takes apart).
CLOSED = r"^(?s:(?P<stem>.*[^İ\PL])(?P<marks>[.,!?;:*$%&#)]+))$"
_loaded: dict[str, TextEncoder] = {}


class TextEncoder:
    """Encodes batches of texts as Tokenizer.encode(text, add_special_tokens=False) does.

    Where the tokenizer drops white space and never joins characters across it (found by a probe when the file is
    loaded), ids of a text are the ids of its words in turn, so that a word met before costs a lookup. Other
    tokenizers get whole texts. Null texts count as empty.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        ids = lambda text: self.model.encode(text, add_special_tokens=False).ids
        probes = (("The", "end."), ("x1", "'s"), ("été", "́a"), ("--", "ok"), ("A", ""))
        self.by_word = ids("AéÉ, b") == ids("aéé") + ids(",") + ids("B") and all(ids(f"{a}{gap}{b}") == ids(a) + ids(b) for a, b in probes for gap in (" ", "\n", "  "))
        self.memo, self.old = {}, {}

    def _words(self, words: list[str]) -> list[bytes]:
        """The ids of each of distinct words, as little-endian unsigned 32 bit."""
        out = list(map(self.memo.get, words))
        missing = [i for i, found in enumerate(out) if found is None]
        if len(self.memo) + len(missing) > MEMO_WORDS // 2:
            self.old, self.memo = self.memo, {}
        memo, old, fresh = self.memo, self.old, []
        for i in missing:
            word = words[i]
            if (found := old.get(word)) is None:
                fresh.append(i)
            else:
                out[i] = memo[word] = found
        for at in range(0, len(fresh), 20_000):
            part = fresh[at : at + 20_000]
            for i, e in zip(part, self.model.encode_batch_fast([words[i] for i in part], add_special_tokens=False), strict=True):
                out[i] = array("I", e.ids).tobytes()
                if len(words[i]) <= MEMO_CHARS:
                    memo[words[i]] = out[i]
        return out

    @staticmethod
    def _split(words: pa.Array) -> tuple[pa.Array, pa.Array]:
        """Each word (in lower case if it is PLAIN) up to its closing marks, and these: they have ids of their own after a letter."""
        words = pc.if_else(pc.match_substring_regex(words, PLAIN), pc.utf8_lower(words), words)
        cut = pc.extract_regex(words, CLOSED)
        return pc.coalesce(pc.struct_field(cut, "stem"), words), pc.fill_null(pc.struct_field(cut, "marks"), "")

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other (unsigned 32 bit), and where each text's begin (one more than texts)."""
        texts = pc.fill_null(texts, "")
        if not self.by_word:
            found = [e.ids for e in self.model.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            ends = np.cumsum([0, *map(len, found)], dtype=np.int64)
            return np.fromiter((i for ids in found for i in ids), np.uint32, int(ends[-1])), ends
        parts = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = pc.dictionary_encode(parts.flatten())
        stems, marks = self._split(coded.dictionary)
        pieces = pc.dictionary_encode(pa.concat_arrays([stems, marks]))
        known = self._words(pieces.dictionary.to_pylist())
        lengths = np.fromiter(map(len, known), np.int64, len(known)) // 4
        flat = np.frombuffer(b"".join(known), np.uint32)
        place = pieces.indices.to_numpy().reshape(2, -1).T[coded.indices.to_numpy()].ravel()  # of each word's stem and marks
        per_piece = lengths[place]
        ids = flat[ragged((np.cumsum(lengths) - lengths)[place], per_piece)]
        per_word = per_piece.reshape(-1, 2).sum(axis=1)
        word_ends = np.concatenate([[0], np.cumsum(per_word)])
        bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(parts).to_numpy())])
        return ids, word_ends[bounds]


def encoder(path: str) -> TextEncoder:
    """The encoder of a file, loaded once in a Python worker."""
    if path not in _loaded:
        _loaded[path] = TextEncoder(path)
    return _loaded[path]


def with_end(ids: np.ndarray, bounds: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with end_id after each text's."""
    return np.insert(ids, bounds[1:], np.uint32(end_id)), bounds + np.arange(len(bounds))
