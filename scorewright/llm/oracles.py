"""DuckDB SQL of the queries that are rules over rows: trees, edits of conversations, exact joins of sets."""

from __future__ import annotations


def crc32(text: str) -> str:
    """Unsigned CRC-32 of an ASCII text expression."""
    codes = f"list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT)"
    byte = "list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {codes}), lambda crc, b: {byte}), 4294967295)"


def manifest(levels: int = 7, top_levels: int = 3) -> str:
    """Trees by hand: level k+1 from level k, up to 8 to the power of `levels` leaves a language."""
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END"
    leaf = lambda text: "sha256(" + " || ".join([*map(field, ("doc_id", "source", "lang", "n_chars")), field(text)]) + ")"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    parts = [
        f"base AS (SELECT row_number() OVER () AS rid, doc_id, lang, {leaf('text')} AS leaf, CASE WHEN {crc32('doc_id::VARCHAR')} % 3 = 0 THEN {leaf(lower)} END AS tampered FROM documents)",
        "n0 AS (SELECT rid, lang, leaf AS node, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, rid) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM base)",
    ]

    def climb(name: str, group: str, levels: int) -> None:
        for k in range(levels):
            parts.append(f"{name}{k + 1} AS (SELECT {group} lang, pos // 8 AS pos, CASE WHEN n > 1 THEN sha256(string_agg(node, '' ORDER BY pos)) ELSE min(node) END AS node, (n + 7) // 8 AS n FROM {name}{k} GROUP BY {group} lang, pos // 8, n)".replace("SELECT  lang", "SELECT lang"))
            both = f"a.lang IS NOT DISTINCT FROM b.lang AND a.pos // 8 = b.pos // 8"  # noqa: F541
            parts.append(f"{name}s{k} AS (SELECT a.lang, a.pos, a.n, coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l, coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r FROM {name}{k} a JOIN {name}{k} b ON {both} GROUP BY a.lang, a.pos, a.n)")

    climb("n", "", levels)
    parts.append(f"t0 AS (SELECT '' AS lang, lang AS name, node, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM n{levels})")
    climb("t", "", top_levels)
    parts.append("p0 AS (SELECT base.*, n0.pos AS leaf_pos, t0.pos AS top_pos, coalesce(tampered, leaf) AS folded, '' AS proof FROM base JOIN n0 USING (rid) JOIN t0 ON t0.name IS NOT DISTINCT FROM base.lang)")
    steps = [(f"ns{k}", f"leaf_pos // {8**k}", " AND s.lang IS NOT DISTINCT FROM p.lang") for k in range(levels)] + [(f"ts{k}", f"top_pos // {8**k}", "") for k in range(top_levels)]
    for k, (name, at, group) in enumerate(steps):
        parts.append(f"p{k + 1} AS (SELECT p.* EXCLUDE (folded, proof), CASE WHEN s.n > 1 THEN sha256(s.l || p.folded || s.r) ELSE p.folded END AS folded, p.proof || s.l || s.r AS proof FROM p{k} p JOIN {name} s ON s.pos = p.{at}{group})")
    whole = ",\n".join(p.replace(" AS (", " AS MATERIALIZED (", 1) for p in parts)  # else DuckDB works a level out anew wherever it is named
    return f"""WITH {whole}
SELECT p.doc_id, p.leaf, n.node AS subroot, t.node AS root, sha256(p.proof) AS proof_sha256, p.folded AS folded_root, p.folded = t.node AS verified
FROM p{len(steps)} p JOIN n{levels} n ON n.lang IS NOT DISTINCT FROM p.lang, t{top_levels} t"""


def repair() -> str:
    """One turn of all conversations a round: the cheapest (cost, audit, text) to each state."""
    white = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    states = range(4)
    after = {0: 2, 1: 2, 2: 3, 3: 2}
    name = {2: "user", 3: "assistant"}
    best = lambda options: f"list_min([{', '.join(options)}])" if options else "NULL"
    more = lambda x, cost, letter, said: f"CASE WHEN {x} IS NOT NULL THEN {{'c': {x}.c + {cost}, 'a': {x}.a || '{letter}', 'r': {x}.r || {said}}} END"

    def inserted(source: str, prefix: str) -> str:
        user = best([f"{prefix}2", *(more(f"{prefix}{s}", 2, "I", "chr(10) || 'user:'") for s in (0, 1, 3))])
        first = f"SELECT * EXCLUDE ({prefix}2), {user} AS {prefix}2 FROM ({source})"
        assistant = best([f"{prefix}3", more(f"{prefix}2", 2, "I", "chr(10) || 'assistant:'")])
        return f"SELECT * EXCLUDE ({prefix}3), {assistant} AS {prefix}3 FROM ({first})"

    start = "{'c': 0, 'a': '', 'r': ''}"
    empty = f"CASE WHEN false THEN {start} END"
    base = inserted(f"SELECT conv_id, 0 AS i, {start} AS s0, {empty} AS s1, {empty} AS s2, {empty} AS s3 FROM turns WHERE i = 1", "s")
    keeps = {1: [(0, "s")], 2: [(0, "u"), (1, "u"), (3, "u")], 3: [(2, "a")]}
    said = "chr(10) || t.role || ':' || t.text"
    columns = []
    for to in states:
        options = [more(f"d.s{to}", 3, "D", "''")]
        options += [f"CASE WHEN NOT t.gone AND t.initial = '{letter}' THEN {more(f'd.s{s}', 't.cut', 'K', said)} END" for s, letter in keeps.get(to, [])]
        options += [f"CASE WHEN NOT t.gone THEN {more(f'd.s{s}', '2 + t.cut', 'R', f"chr(10) || '{name[to]}:' || t.text")} END" for s in states if after[s] == to]
        columns.append(f"{best(options)} AS s{to}")
    step = inserted(f"SELECT d.conv_id, t.i, {', '.join(columns)} FROM walk d JOIN turns t ON d.conv_id = t.conv_id AND t.i = d.i + 1", "s")
    return f"""
WITH RECURSIVE hit AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32("conv_id || ':' || turn")} % 20 AS damage
  FROM conversations),
hurt AS (
  SELECT conv_id, turn, CASE WHEN damage = 4 THEN 'user' ELSE role END AS role,
         CASE damage WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM (SELECT *, unnest(range(CASE WHEN damage = 3 THEN 2 ELSE 1 END)) AS copy FROM hit WHERE damage <> 0)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i, trim(text, {white}) AS bare FROM hurt),
judged AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again FROM placed),
turns AS (
  SELECT *, left(role, 1) AS initial, bare = '' AS blank, bare <> '' AND again AS duplicate,
         bare <> '' AND NOT again AND right(bare, 1) NOT IN ('.', '!', '?') AS truncated,
         bare = '' OR again AS gone, CASE WHEN right(bare, 1) IN ('.', '!', '?') THEN 0 ELSE 1 END AS cut,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS neighbours
  FROM judged),
walk AS (({base}) UNION ALL ({step})),
counts AS (
  SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, sum(blank::INT) AS blank, sum(duplicate::INT) AS duplicate,
         sum(truncated::INT) AS truncated, sum((neighbours NOT IN ('su', 'ua', 'au'))::INT) AS illegal, max(i) AS n
  FROM turns GROUP BY conv_id),
solved AS (
  SELECT c.*, list_min([w.s0, w.s3]) AS best FROM counts c JOIN walk w ON w.conv_id = c.conv_id AND w.i = c.n)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.c, 0)::BIGINT AS cost,
       coalesce(best.a, '') AS audit, sha256(coalesce(substr(best.r, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN solved USING (conv_id)
"""


def jaccard(words: int = 3, percent: int = 90) -> str:
    """Pairs by their common shingles, components by reach. Texts without words link with nothing."""
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH RECURSIVE cut AS (
  SELECT doc_id, regexp_extract_all({lower}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {words} THEN [list_aggregate(w, 'string_agg', ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - {words - 2}), lambda i: list_aggregate(w[i:i + {words - 1}], 'string_agg', ' '))) END AS s
  FROM cut),
sizes AS (SELECT doc_id, len(s) AS n FROM sets),
each AS (SELECT doc_id, unnest(s) AS x FROM sets),
met AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM each a JOIN each b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT met.a, met.b FROM met JOIN sizes p ON p.doc_id = met.a JOIN sizes q ON q.doc_id = met.b WHERE 100 * c >= {percent} * (p.n + q.n - c)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS root FROM sizes UNION SELECT e.b, r.root FROM reach r JOIN edges e ON e.a = r.doc_id WHERE r.root < e.b)
SELECT s.doc_id, s.n AS n_shingles, (SELECT min(root) FROM reach r WHERE r.doc_id = s.doc_id) AS component_id FROM sizes s
"""
