"""Merkle manifests against trees built by a plain loop."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from conftest import SF
from pyspark.sql import functions as F
from scorewright.llm import merkle, queries

from .conftest import EDGE


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def levels(leaves, fanout=8):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([digest(*out[-1][i : i + fanout]) for i in range(0, len(out[-1]), fanout)])
    return out


def siblings(tree, i, fanout=8):
    out = []
    for level in tree[:-1]:
        a = i // fanout * fanout
        run = level[a : a + fanout]
        out.append(("".join(run[: i - a]), "".join(run[i - a + 1 :])))
        i //= fanout
    return out


def manifest(rows, fanout=8):
    """(id, leaf, subroot, root, path) for rows (id, group, leaf)."""
    groups = {}
    for i, group, leaf in rows:
        groups.setdefault(group, []).append((i is not None, i if i is not None else 0, leaf))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = [levels([x[2] for x in sorted(groups[g])], fanout) for g in names]
    top = levels([t[-1][0] for t in trees], fanout)
    return [(x[1] if x[0] else None, x[2], trees[k][-1][0], top[-1][0], siblings(trees[k], n, fanout) + siblings(top, k, fanout)) for k, g in enumerate(names) for n, x in enumerate(sorted(groups[g]))]


def collected(df):
    return sorted(((r.doc_id, r.leaf, r.subroot, r.root, [(p.before, p.after) for p in r.path]) for r in df.collect()), key=repr)


@pytest.mark.parametrize("fanout", [2, 8])
def test_op11_trees_of_any_size(spark, fanout):
    """Groups of one to many leaves, more groups than the fanout, names with colons, null and empty, ids that repeat or lack."""
    rng = random.Random(3)
    rows = [(i, rng.choice(["en"] * 6 + ["de", None, "é", "", "a:b"])) for i in range(700)] + [(5000 + i, f"l{i}") for i in range(11)] + [(9000 + i, f"n{n}") for n in (8, 9, 64, 65) for i in range(n)] + [(None, "en"), (3, "en"), (3, "en"), (3, "en")]
    df = spark.createDataFrame(rows, "doc_id long, lang string").withColumn("leaf", merkle.leaf(F.col("doc_id"), F.col("lang")))
    want = manifest([(i, g, digest(field(i) + field(g))) for i, g in rows], fanout)
    assert collected(merkle.proofs(df, fanout=fanout)) == sorted(want, key=repr)


def test_op11_whole_table(spark, docs):
    """Every column of the query, by the contract's words."""
    table = [r.asDict() for r in docs.collect()]
    leaf_of = lambda r: digest(*(field(r[c]) for c in ("doc_id", "source", "lang", "n_chars", "text")))
    lower = str.maketrans(queries.UPPER, queries.UPPER.lower())
    by_id = {r["doc_id"]: r for r in table}
    want = {}
    for i, leaf, subroot, root, path in manifest([(r["doc_id"], r["lang"], leaf_of(r)) for r in table]):
        row = by_id[i]
        now = leaf_of(row | {"text": row["text"].translate(lower)}) if zlib.crc32(str(i).encode()) % 3 == 0 else leaf
        for before, after in path:
            now = digest(before, now, after)
        want[i] = (leaf, subroot, root, digest(*(x for step in path for x in step)), now, now == root)
    got = {r.doc_id: (r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in queries.op11_manifest(spark, SF).collect()}
    assert got == want and {w[5] for w in want.values()} == {True, False}


def test_op11_sql(spark, assert_oracle):
    assert_oracle(queries.op11_manifest, queries.ORACLE_SQL["op11_manifest"])


def test_op11_edges(edge, empty):
    leaves = lambda df: df.withColumn("leaf", merkle.leaf(F.col("doc_id"), F.col("text")))
    want = manifest([(i, None if (i or 0) % 3 == 0 else "en", digest(field(i) + field(t))) for i, t in EDGE])
    assert collected(merkle.proofs(leaves(edge))) == sorted(want, key=repr)
    assert merkle.proofs(leaves(empty)).count() == 0


def test_op11_fields_stay_apart(spark):
    """Null, empty and shifted fields have different leaves."""
    rows = spark.createDataFrame([(None, ""), ("", None), ("a", "b"), ("ab", ""), ("", "ab"), ("1:a", None)], "x string, y string")
    assert rows.select(merkle.leaf(F.col("x"), F.col("y"))).distinct().count() == 6
