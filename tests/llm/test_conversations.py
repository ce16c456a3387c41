"""Repair of conversations against a search over all edits."""

from __future__ import annotations

import hashlib
import itertools
import random
import zlib

from conftest import SF
from scorewright.llm import conversations, queries

SPACE = " \t\n\x0b\x0c\r"


def searched(rows):
    """The cheapest edits of rows (role, fault) by trying all of them: (cost, audit, repaired (role, edit, row) of each)."""
    best = None

    def go(i, state, cost, audit, out):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        if i == len(rows) and state in "-a" and (best is None or (cost, audit) < best[:2]):
            best = (cost, audit, out)
        after = {"-": "u", "s": "u", "a": "u", "u": "a"}[state]
        name = {"u": "user", "a": "assistant"}[after]
        if not audit.endswith("II"):
            go(i, after, cost + 2, audit + "I", [*out, (name, None)])
        if i < len(rows):
            role, fault = rows[i]
            go(i + 1, state, cost + 3, audit + "D", out)
            if fault not in ("blank", "duplicate"):
                worse = cost + (fault == "truncated")
                first = role[:1]
                if first == after or (first == "s" and state == "-"):
                    go(i + 1, first, worse, audit + "K", [*out, (role, i)])
                go(i + 1, after, worse + 2, audit + "R", [*out, (name, i)])

    go(0, "-", 0, "", [])
    return best


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        what = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if what == 0:
            continue
        text = "" if what == 1 else "".join(c for c in text if c not in ".!?") if what == 2 else text
        out += [(conv, turn, "user" if what == 4 else role, text)] * (2 if what == 3 else 1)
    return out


def told(rows):
    """conv_id -> all columns of the result for rows (conv_id, turn, role, text)."""
    out = {}
    for conv in {r[0] for r in rows}:
        mine = [(t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows if c == conv]
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
        seen, marked = set(), []
        for _, role, text in mine:
            bare = text.strip(SPACE)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            marked.append((role, fault))
        cost, audit, kept = searched(marked)
        turns = {t for t, _, _ in mine if t is not None}
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(mine))
        said = "\n".join(f"{role}:{'' if i is None else mine[i][2]}" for role, i in kept)
        count = lambda name: sum(f == name for _, f in marked)
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, hashlib.sha256(said.encode()).hexdigest())
    return out


def columns(r):
    return (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256)


def test_op12_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = told(damaged(rows))
    got = {r.conv_id: columns(r) for r in queries.op12_repair(spark, SF).collect()}
    assert set(got) == {r[0] for r in rows}
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got == {c: want.get(c, nothing) for c in got}


def test_op12_sql(assert_oracle):
    assert_oracle(queries.op12_repair, queries.ORACLE_SQL["op12_repair"])


def test_op12_any_rows(spark):
    """Random roles, faults, ties, nulls in every column; a table with other columns; an empty one."""
    rng = random.Random(12)
    texts = ["yes.", "no!", "cut off", " ", "", None, "why?  ", "\x0b", "so.\x85"]
    rows = [(c or None, rng.choice([None, *range(4)]), rng.choice(["system", "user", "assistant", "tool", "User", "", None]), rng.choice(texts)) for c in range(160) for _ in range(rng.randrange(1, 7))]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, key int, audit string")
    assert {r.conv_id: columns(r) for r in conversations.repair(df).collect()} == told(rows)
    assert conversations.repair(df.limit(0)).count() == 0


def test_op12_long_conversations(spark, monkeypatch):
    """Pieces folded give what one walk over all turns gives; the repaired turns have the digest's text."""
    rng = random.Random(4)
    rows = [(c, t, rng.choice(["user", "assistant", "assistant", "system"]), f"text {rng.randrange(900)}" + rng.choice([".", ".", ""])) for c in range(3) for t in range([700, 256, 513][c])]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    long = {r.conv_id: columns(r) for r in conversations.repair(df).collect()}
    plans = conversations.audits(df)
    said = {}
    for r in sorted(conversations.repaired_turns(df, plans).collect(), key=lambda r: (r.key, r.place)):
        said.setdefault(int(r.key.split(":")[1]), []).append(f"{r.role}:{r.text}")
    assert {c: hashlib.sha256("\n".join(x).encode()).hexdigest() for c, x in said.items()} == {c: v[7] for c, v in long.items()}
    for c in range(3):
        layer = conversations.first_layer(0)
        seen = set()
        for _, _, role, text in [r for r in rows if r[0] == c]:
            symbol = "x" if (role, text) in seen else role[0] if text.endswith(".") else role[0].upper()
            seen.add((role, text))
            layer = conversations.next_layer(layer, symbol)
        assert long[c][5:7] == min(b for g, b in enumerate(layer) if g in (0, 3) and b is not None)
