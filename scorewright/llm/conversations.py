"""Repair of conversations: which turns to keep, give another role, delete or insert at the least cost, by one walk over a trie of all their signatures."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorewright.llm.common import hot_keys, join_unique, through_files
from scorewright.llm.merkle import encoded

#: Turns of a signature at most; longer conversations are several signatures in a row.
PIECE = 256

#: White space, marks that end a sentence, adjacent initials of roles that may stand together.
WHITE, ENDS, LEGAL = " \t\n\x0b\x0c\r", ".!?", {"su", "ua", "au"}

KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 2, 3, 2, 1

# What was said so far: nothing, the system's turn, a user's turn, an assistant's turn. A conversation ends in the first or last.
_STATES, _GOALS = range(4), (0, 3)
_NEXT = {0: 2, 1: 2, 2: 3, 3: 2}
_KEPT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}, "o": {}}

Layer = list[tuple[int, str] | None]


def _better(layer: Layer, state: int, cost: int, audit: str) -> None:
    if layer[state] is None or (cost, audit) < layer[state]:
        layer[state] = (cost, audit)


def _with_inserts(layer: Layer) -> Layer:
    for state in (0, 1, 3, 2):  # a user's turn after what may stand before it, then an assistant's
        if layer[state] is not None:
            _better(layer, _NEXT[state], layer[state][0] + INSERT, layer[state][1] + "I")
    return layer


def first_layer(start: int) -> Layer:
    return _with_inserts([(0, "") if state == start else None for state in _STATES])


def next_layer(layer: Layer, symbol: str) -> Layer:
    """Cheapest (cost, audit) to each state after one more turn. Of equal costs no audit begins another, so the least stays the least."""
    out: Layer = [None] * len(_STATES)
    for state, best in enumerate(layer):
        if best is None:
            continue
        cost, audit = best
        _better(out, state, cost + DELETE, audit + "D")
        if symbol != "x":
            worse = cost + (CUT_OFF if symbol.isupper() else 0)
            if (to := _KEPT[symbol.lower()].get(state)) is not None:
                _better(out, to, worse + KEEP, audit + "K")
            _better(out, _NEXT[state], worse + REROLE, audit + "R")
    return _with_inserts(out)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For sorted signatures: each with its (from, to, cost, audit). The path from the trie's root to the last one is kept, and what the next shares of it isn't computed again."""
    path, layers = "", [[first_layer(s) for s in _STATES]]
    cell = pa.struct([("start", pa.int32()), ("goal", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
    for batch in batches:
        out = []
        for signature in batch.column("signature").to_pylist():
            shared = next((i for i, (a, b) in enumerate(zip(path, signature, strict=False)) if a != b), min(len(path), len(signature)))
            del layers[shared + 1 :]
            for symbol in signature[shared:]:
                layers.append([next_layer(layer, symbol) for layer in layers[-1]])
            path = signature
            out.append([{"start": s, "goal": g, "cost": best[0], "audit": best[1]} for s in _STATES for g, best in enumerate(layers[-1][s]) if best is not None])
        yield pa.RecordBatch.from_arrays([batch.column("signature"), pa.array(out, pa.list_(cell))], names=["signature", "cells"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For rows (key, initial, symbol) in order: pieces (key, part, no, signature, initials at both ends, illegal neighbours inside)."""
    part, number, out, here = TaskContext.get().partitionId(), 0, [], None
    symbols: list[str] = []
    initials: list[str] = []

    def close() -> None:
        nonlocal number
        if symbols:
            wrong = sum(a + b not in LEGAL for a, b in pairwise(initials))
            out.append((here, part, number, "".join(symbols), initials[0], initials[-1], wrong))
            number += 1
        symbols.clear()
        initials.clear()

    def made() -> pa.RecordBatch:
        kinds = (pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64())
        batch = pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=["key", "part", "no", "signature", "first", "last", "illegal"])
        out.clear()
        return batch

    for batch in batches:
        for key, initial, symbol in zip(*(batch.column(c).to_pylist() for c in ("key", "initial", "symbol")), strict=True):
            if key != here or len(symbols) == PIECE:
                close()
                here = key
            symbols.append(symbol)
            initials.append(initial)
        yield made()
    close()
    yield made()


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For pieces with their cells, in order: (key, cost, audit, illegal) of each conversation."""
    here, out = None, []
    best: Layer = []
    illegal, last = 0, ""

    def close() -> None:
        if here is not None:
            cost, audit = min(b for g, b in enumerate(best) if g in _GOALS and b is not None)
            out.append((here, cost, audit, illegal))

    def made() -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.string(), pa.int64())
        batch = pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=["key", "cost", "audit", "illegal"])
        out.clear()
        return batch

    for batch in batches:
        for key, cells, first, end, wrong in zip(*(batch.column(c).to_pylist() for c in ("key", "cells", "first", "last", "illegal")), strict=True):
            if key != here:
                close()
                here, best, illegal, last = key, [(0, ""), None, None, None], 0, ""
            after: Layer = [None] * len(_STATES)
            for c in cells:
                if (before := best[c["start"]]) is not None:
                    _better(after, c["goal"], before[0] + c["cost"], before[1] + c["audit"])
            illegal += wrong + (last != "" and last + first not in LEGAL)
            best, last = after, end
        yield made()
    close()
    yield made()


def _turns(conversations: DataFrame) -> DataFrame:
    conv = F.col("conv_id")
    return conversations.select(encoded(conv).alias("key"), conv, "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))


def _ordered(*more: str) -> list[Column]:
    return [F.col("key"), *(F.col(c) for c in more), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]


def faults(conversations: DataFrame) -> DataFrame:
    """(key, conv_id, turn, role, digest, row, fault) of every turn: fault is blank, duplicate, truncated or empty, the first that fits.

    Blank texts have nothing but white space; duplicates repeat role and text of an earlier turn of the conversation;
    truncated texts don't end in a mark. Texts stay where they are: their SHA-256 stands for them.
    """
    turns = _turns(conversations).withColumn("row", F.monotonically_increasing_id())
    bare = F.rtrim("text", F.lit(WHITE))
    fault = F.when(bare == "", "blank").when(~F.right(bare, F.lit(1)).isin(*ENDS), "truncated").otherwise("")
    light = through_files(turns.select("key", "conv_id", "turn", "role", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), "row", fault.alias("fault")))
    place = F.struct("turn", "row")
    several = through_files(light.where("fault != 'blank'").groupBy("key", "role", "digest").agg(F.min(place).alias("earliest"), F.count("*").alias("times")).where("times > 1"))
    found = light.join(several, ["key", "role", "digest"], "left")
    again = (F.col("fault") != "blank") & F.col("earliest").isNotNull() & ~place.eqNullSafe(F.struct(F.col("earliest.turn").alias("turn"), F.col("earliest.row").alias("row")))
    return found.select("key", "conv_id", "turn", "role", "digest", "row", F.when(again, "duplicate").otherwise(F.col("fault")).alias("fault"))


def audits(conversations: DataFrame) -> DataFrame:
    """One row per conv_id of `conversations` (conv_id, turn, role, text): gaps, blank, duplicate, truncated, illegal, cost, audit.

    A conversation's turns are taken in order of turn, nulls first, ties by role and the text's digest; a null role or
    text counts as one space. gaps are numbers missing between the least and greatest turn; illegal counts neighbours
    whose roles' initials are not su, ua or au. The audit has the initials of the cheapest edits that make the roles'
    initials `(s?(ua)+)?`, the ASCII-least of them: Keep 0, Rerole 2, Delete 3 (the only one for blank and duplicate
    turns), Insert 2, and 1 more for each truncated turn that stays. Null ids are one conversation; an empty table gives no
    rows; other columns are ignored.

    Turns, without texts, are sorted in ranges that split conversations of any size; each range cuts them in pieces of
    PIECE symbols, one for role and fault. The distinct signatures of all pieces are sorted, and each task walks their
    trie: a layer of the dynamic programme is computed once for all signatures that begin alike. A piece's costs hold
    for any state before it, so a long conversation is folded from its pieces.
    """
    turns = through_files(faults(conversations))
    known = F.left("role", F.lit(1))
    initial = F.when(known.isin("s", "u", "a"), known).otherwise("o")
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper(initial)).otherwise(initial)
    partitions = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = turns.repartitionByRange(partitions, *_ordered(), "row").sortWithinPartitions(*_ordered(), "row")
    pieces = through_files(ranged.select("key", initial.alias("initial"), symbol.alias("symbol")).mapInArrow(_cut, "key string, part int, no long, signature string, first string, last string, illegal long"))
    counts = through_files(pieces.groupBy("signature").agg(F.count("*").alias("copies")))
    walked = counts.select("signature").repartitionByRange(partitions, "signature").sortWithinPartitions("signature")
    cells = through_files(walked.mapInArrow(_walk, "signature string, cells array<struct<start:int,goal:int,cost:long,audit:string>>"))
    solved = join_unique(pieces, cells, "signature", hot_keys(counts, "signature"))
    folded = solved.repartition(partitions, "key").sortWithinPartitions("key", "part", "no").mapInArrow(_fold, "key string, cost long, audit string, illegal long")
    is_ = lambda name: F.count(F.when(F.col("fault") == name, 1))
    by_turn = turns.groupBy("key", "turn").agg(F.first("conv_id").alias("conv_id"), *(is_(n).alias(n) for n in ("blank", "duplicate", "truncated")))
    span = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long")
    totals = by_turn.groupBy("key").agg(F.first("conv_id").alias("conv_id"), span.alias("gaps"), *(F.sum(n).alias(n) for n in ("blank", "duplicate", "truncated")))
    return totals.join(folded, "key").select("key", "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """For a plan and then the turns of each conversation: lists of (key, edit, role, text) after its edits; a closing one has no edit."""
    here, audit, at, last = None, "", 0, ""

    def follow(row: tuple[str, str] | None, out: list[tuple]) -> None:
        """Edits up to and with that of a turn; without one, the inserts that are left."""
        nonlocal at, last
        while at < len(audit) and (row is not None or audit[at] == "I"):
            edit = audit[at]
            at += 1
            if edit == "K":
                out.append((here, edit, *row))
                last = row[0][:1]
            elif edit != "D":
                role = "assistant" if last == "u" else "user"
                out.append((here, edit, role, "" if edit == "I" else row[1]))
                last = role[0]
            if edit != "I":
                return

    def close(out: list[tuple]) -> None:
        follow(None, out)
        if here is not None:
            out.append((here, None, None, None))

    for batch in batches:
        out: list[tuple] = []
        for key, plan, role, text in zip(*(batch.column(c).to_pylist() for c in ("key", "audit", "role", "text")), strict=True):
            if plan is None:
                follow((role, text), out)
            else:
                close(out)
                here, audit, at, last = key, plan, 0, ""
        yield out
    out = []
    close(out)
    yield out


def _beside(conversations: DataFrame, plans: DataFrame) -> DataFrame:
    """Each conversation's plan, then its turns in order: texts move once, and are streamed."""
    turns = _turns(conversations).select("key", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("audit"), "turn", "role", "text", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"))
    first = plans.select("key", F.lit(0).alias("kind"), "audit", *(F.lit(None).cast(turns.schema[c].dataType).alias(c) for c in ("turn", "role", "text", "digest")))
    n = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return first.unionByName(turns).repartition(n, "key").sortWithinPartitions(*_ordered("kind")).select("key", "audit", "role", "text")


def repaired_turns(conversations: DataFrame, plans: DataFrame) -> DataFrame:
    """(key, place, edit, role, text) of all turns after the edits of `plans` (audits() of the same rows); deleted ones are gone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = 0
        for rows in _repaired(batches):
            kept = []
            for key, edit, role, text in rows:
                if edit is None:
                    place = 0
                else:
                    kept.append((key, place, edit, role, text))
                    place += 1
            kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in kept], kind) for k, kind in enumerate(kinds)], names=["key", "place", "edit", "role", "text"])

    return _beside(conversations, plans).mapInArrow(run, "key string, place long, edit string, role string, text string")


def repaired_digests(conversations: DataFrame, plans: DataFrame) -> DataFrame:
    """(key, repaired_sha256): SHA-256 of the repaired turns as `role:text`, joined by newlines; no task holds a conversation, only the digest's state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, said = hashlib.sha256(), False
        for rows in _repaired(batches):
            keys, digests = [], []
            for key, edit, role, text in rows:
                if edit is None:
                    keys.append(key)
                    digests.append(state.hexdigest())
                    state, said = hashlib.sha256(), False
                else:
                    state.update(f"{chr(10) * said}{role}:{text}".encode())
                    said = True
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(digests, pa.string())], names=["key", "repaired_sha256"])

    return _beside(conversations, plans).mapInArrow(run, "key string, repaired_sha256 string")


def repair(conversations: DataFrame) -> DataFrame:
    """audits() with repaired_sha256, one row per conv_id."""
    plans = through_files(audits(conversations))
    return plans.join(repaired_digests(conversations, plans), "key").drop("key")
