"""Packing of documents into training windows by best-fit decreasing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from scorewright.llm.common import slices
from scorewright.llm.tokens import encoder, with_end

#: Pieces that wait in a task at most before they are packed: it bounds the task's memory.
FLUSH_PIECES, FLUSH_IDS = 65_536, 16 << 20

SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


class OpenWindows:
    """Open windows by remaining capacity; a segment tree over capacities finds the tightest one that fits."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.any = [0] * (2 * self.leaves)
        self.at: list[list[int]] = [[] for _ in range(size + 1)]

    def put(self, window: int, room: int) -> None:
        self.at[room].append(window)
        node = room + self.leaves
        while node:
            self.any[node] += 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The window with the least room of at least `need`, and its room; it is no longer open."""
        node = need + self.leaves
        if not self.any[node]:
            while node > 1 and (node & 1 or not self.any[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.any[2 * node] else 2 * node + 1
        room = node - self.leaves
        while node:
            self.any[node] -= 1
            node >>= 1
        return self.at[room].pop(), room


def best_fit(lengths: list[int], size: int) -> list[list[int]]:
    """Windows as lists of pieces (their positions in `lengths`), longest pieces first."""
    rooms, windows = OpenWindows(size), []
    for piece in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        need = lengths[piece]
        if (found := rooms.take(need)) is None:
            windows.append([piece])
            window, room = len(windows) - 1, size
        else:
            window, room = found
            windows[window].append(piece)
        if room > need:
            rooms.put(window, room - need)
    return windows


def filled(windows: list[list[tuple[int, int, int]]], size: int, gap: int) -> tuple[list[list[tuple[int, int, int]]], list[tuple[int, int, int]]]:
    """Windows of pieces (name, start, length) whose room is over `gap` filled up with cut pieces of the emptiest ones; and what is left over.

    The pieces of the emptiest window go into the fullest ones, cut where they don't fit, and so on until the two meet.
    """
    used = [sum(n for _, _, n in w) for w in windows]
    order = sorted((k for k in range(len(windows)) if size - used[k] > gap), key=lambda k: -used[k])
    done = [w for w, n in zip(windows, used, strict=True) if size - n <= gap]
    front, back, todo = 0, len(order) - 1, []
    while front < back or front == back and todo:
        window, room = list(windows[order[front]]), size - used[order[front]]
        while room and (todo or front < back):
            if not todo:
                todo, back = list(reversed(windows[order[back]])), back - 1
            name, start, n = todo.pop()
            window.append((name, start, min(n, room)))
            if n > room:
                todo.append((name, start + room, n - room))
            room -= min(n, room)
        front += 1
        if room > gap:  # nothing is left to fill it with
            return done, window
        done.append(window)
    return done, todo[::-1] + (windows[order[front]] if front == back else [])


def split_tail(pieces: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """Pieces (name, start, length) cut into sequences of powers of two, which need no padding."""
    left, out, todo = sum(n for _, _, n in pieces), [], list(reversed(pieces))
    while left:
        room = 1 << (left.bit_length() - 1)
        left -= room
        out.append([])
        while room:
            name, start, n = todo.pop()
            out[-1].append((name, start, min(n, room)))
            if n > room:
                todo.append((name, start + room, n - room))
            room -= min(n, room)
    return out


def pack(docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1, id_column: str = "doc_id", text_column: str = "text", tail_gap: int = 128) -> DataFrame:
    """One row per piece of a document: its ids (little-endian unsigned 32 bit), where they come from, and their place.

    A document is its token ids, then end_id. A document longer than the window is first cut into full windows, which
    are sequences of their own; what remains is packed by best-fit decreasing among the pieces of the same input
    partition, so that nothing is shuffled and each task stays within FLUSH_PIECES and FLUSH_IDS. Windows that best fit
    leaves with a gap over `tail_gap` are filled with cut pieces of the emptiest of them. What is left at the end, less
    than a window each time pieces are packed, is cut into sequences of powers of two, which are not padded.
    sequence_id is unique in the result: the partition's number and a count.

    Null and empty texts are documents of one id; null ids stay null; repeated rows are documents of their own; an
    empty table gives no rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        next_id = TaskContext.get().partitionId() << 33
        waiting: list[tuple[int | None, int, int, np.ndarray]] = []
        waiting_ids = 0

        def rows(sequences: list[list[tuple[int | None, int, int, np.ndarray]]]) -> Iterator[pa.RecordBatch]:
            nonlocal next_id
            for at in range(0, len(sequences), 1000):
                cols: list[list] = [[] for _ in range(7)]
                for sequence in sequences[at : at + 1000]:
                    offset = 0
                    for doc, start, total, ids in sequence:
                        for col, value in zip(cols, (doc, start, len(ids), total, next_id, offset, ids.tobytes()), strict=True):
                            col.append(value)
                        offset += len(ids)
                    next_id += 1
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:6]), pa.array(cols[6], pa.binary())], names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal waiting, waiting_ids
            windows, left = filled([[(i, 0, len(waiting[i][3])) for i in found] for found in best_fit([len(p[3]) for p in waiting], window)], window, tail_gap)
            tail = [left] if window - sum(n for _, _, n in left) <= tail_gap else split_tail(left)
            sequences = [[(waiting[i][0], waiting[i][1] + s, waiting[i][2], waiting[i][3][s : s + n]) for i, s, n in found] for found in windows + tail]
            waiting, waiting_ids = [], 0
            yield from rows(sequences)

        for batch in slices(batches, text_column):
            ids, bounds = with_end(*encode(batch.column(text_column)), end_id)
            ids = ids.astype("<u4")
            full = []
            for doc, a, b in zip(batch.column(id_column).to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                cut = a + (b - a) // window * window
                full += [[(doc, s - a, b - a, ids[s : s + window])] for s in range(a, cut, window)]
                if cut < b:
                    waiting.append((doc, cut - a, b - a, ids[cut:b].copy()))
                    waiting_ids += b - cut
            yield from rows(full)
            if len(waiting) >= FLUSH_PIECES or waiting_ids >= FLUSH_IDS:
                yield from flush()
        yield from flush()

    return docs.select(id_column, text_column).mapInArrow(run, SCHEMA)
