"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANK_WORDS = r"[^\x20\x09-\x0D]+"
ALNUM_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(table: str, key: str, pattern: str, fold: bool) -> str:
    text = "coalesce(text, '')"
    text = f"translate({text}, '{UPPER}', '{LOWER}')" if fold else text
    return f"SELECT {key}, regexp_extract_all({text}, '{pattern}') AS ws FROM {table}"


OP1 = f"""WITH w AS ({_words('documents', 'doc_id', BLANK_WORDS, False)}),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35),
k AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 34], ' ')) AS h FROM p),
r AS (SELECT doc_id, i FROM k WHERE h IN (SELECT h FROM k GROUP BY h HAVING count(*) > 1)),
c AS (SELECT DISTINCT doc_id, j FROM (SELECT doc_id, unnest(range(i, i + 35)) AS j FROM r)),
x AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS j FROM w),
t AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.j) AS kept FROM x LEFT JOIN c ON c.doc_id = x.doc_id AND c.j = x.j WHERE c.j IS NULL GROUP BY 1),
n AS (SELECT doc_id, count(*) AS n FROM c GROUP BY 1)
SELECT w.doc_id, len(ws) AS n_words, coalesce(n.n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN t ON t.doc_id = w.doc_id"""

OP2 = f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS n FROM documents),
s AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS k FROM l WHERE line <> ''),
w AS (SELECT doc_id, k, line || chr(10) || lead(line) OVER (PARTITION BY doc_id ORDER BY k) AS pair FROM s),
d AS (SELECT doc_id, k FROM (SELECT doc_id, k, row_number() OVER (PARTITION BY pair ORDER BY doc_id, k) AS o FROM w WHERE pair IS NOT NULL) WHERE o > 1),
o AS (SELECT doc_id, k, line FROM (SELECT *, row_number() OVER (PARTITION BY line ORDER BY doc_id, k) AS o FROM s) WHERE o > 1),
g AS (SELECT DISTINCT doc_id, k FROM (SELECT doc_id, k FROM d UNION ALL SELECT doc_id, k + 1 FROM d UNION ALL SELECT doc_id, k FROM o WHERE len(regexp_extract_all(line, '{BLANK_WORDS}')) >= 50)),
a AS (SELECT g.doc_id, count(*) AS n_removed, count(*) FILTER (b.k IS NULL) AS n_runs FROM g LEFT JOIN g b ON b.doc_id = g.doc_id AND b.k = g.k - 1 GROUP BY 1),
t AS (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.n) AS kept, max(length(l.line)) AS longest FROM l LEFT JOIN s ON s.doc_id = l.doc_id AND s.n = l.n LEFT JOIN g ON g.doc_id = s.doc_id AND g.k = s.k WHERE g.k IS NULL GROUP BY 1),
c AS (SELECT doc_id, count(*) AS n_lines FROM s GROUP BY 1)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(n_runs, 0) AS n_runs,
sha256(CASE WHEN n_removed IS NULL THEN coalesce(text, '') WHEN longest > 0 THEN kept ELSE '' END) AS kept_sha256
FROM documents d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN a ON a.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id"""

OP6 = f"""WITH RECURSIVE w AS ({_words('documents', 'doc_id', BLANK_WORDS, True)}),
p AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(ws[i:i + 4], ' ')) AS h FROM p),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
m AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM m JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * common >= 80 * (a.n + b.n - common)),
b AS (SELECT x AS src, y AS dst FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT DISTINCT src AS doc_id, src AS reached FROM b UNION SELECT r.doc_id, b.dst FROM r JOIN b ON b.src = r.reached),
c AS (SELECT doc_id, min(reached) AS least FROM r GROUP BY 1)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(least, w.doc_id) AS component_id FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN c ON c.doc_id = w.doc_id"""

OP8 = f"""WITH w AS ({_words('documents', 'doc_id', ALNUM_WORDS, True)}), b AS ({_words('benchmark', 'item_id', ALNUM_WORDS, True)}),
v AS (SELECT DISTINCT item_id, size, md5(array_to_string(ws[i:i + size - 1], ' ')) AS h FROM (SELECT item_id, ws, least(len(ws), 10) AS size, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
z AS (SELECT DISTINCT size FROM v),
p AS (SELECT doc_id, size, ws, unnest(range(1, len(ws) - size + 2)) AS i FROM w, z WHERE len(ws) >= size),
k AS (SELECT doc_id, size, i, md5(array_to_string(ws[i:i + size - 1], ' ')) AS h FROM p),
f AS (SELECT k.doc_id, k.i, k.size, v.item_id FROM k JOIN v ON v.h = k.h AND v.size = k.size),
c AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS j FROM f) GROUP BY 1),
g AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM f) GROUP BY 1)
SELECT w.doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM w LEFT JOIN c ON c.doc_id = w.doc_id LEFT JOIN g ON g.doc_id = w.doc_id"""

def _lloyd(rounds: int) -> str:
    """Rounds of assignment and means over whole-number vectors, spelt out; the list of centroids of round r is c{r}."""
    near = lambda r: f"a{r} AS MATERIALIZED (SELECT vec_id, rid, min({{'d': list_sum(list_transform(list_zip(q, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'k': k}}) AS m FROM v, c{r} GROUP BY vec_id, rid)"
    out = [
        "v AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS rid, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)",
        "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS k, q AS c FROM (SELECT sha256('1:' || vec_id) AS h, q FROM v ORDER BY h LIMIT 16))",
        near(0),
    ]
    for r in range(1, rounds + 1):
        out += [
            f"s{r} AS (SELECT m.k AS k, i, sum(x) AS s, count(*) AS n FROM (SELECT m, unnest(q) AS x, unnest(range(64)) AS i FROM a{r - 1} JOIN v USING (rid)) GROUP BY 1, 2)",
            f"t{r} AS (SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM s{r} GROUP BY k)",
            f"c{r} AS MATERIALIZED (SELECT o.k, coalesce(t.c, o.c) AS c FROM c{r - 1} o LEFT JOIN t{r} t ON t.k = o.k)",
            near(r),
        ]
    return ", ".join(out)


OP13 = f"""WITH {_lloyd(3)}
SELECT vec_id, CAST(m.k AS INTEGER) AS cluster, CAST(m.d AS BIGINT) AS distance, CAST(sum(m.d) OVER (PARTITION BY m.k) AS BIGINT) AS cluster_inertia,
CAST(sum(m.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a3 JOIN c3 ON c3.k = m.k"""

#: crc32 of a short ASCII string, by a table of the remainders of all bytes.
_CRC = """crc AS MATERIALIZED (SELECT list(list_reduce(list_prepend(n, range(8)), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) ORDER BY n) AS t FROM range(256) AS r(n)),
raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
ops AS (SELECT raw.*, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(name, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda x, b: xor(x >> 8, t[1 + (xor(x, b) & 255)])), 4294967295) % 20 AS op FROM raw, crc)"""


def _edits() -> str:
    """Moves of the grammar: inserted rows go before a row's own edit."""
    after, inserts = {"E": "U", "S": "U", "U": "A", "A": "U"}, []
    for source in after:
        at = source
        for k in range(3):
            inserts.append(f"('{source}', '{at}', '{'I' * k}', {5 * k})")
            at = after[at]
    new = ", ".join(f"('{a}', '{b}')" for a, b in after.items())
    keep = "('E', 's', 'S'), ('E', 'u', 'U'), ('S', 'u', 'U'), ('U', 'a', 'A'), ('A', 'u', 'U')"
    return f"""ins AS (SELECT * FROM (VALUES {', '.join(inserts)}) AS v(source, here, edits, cost)),
mv AS (SELECT source, here AS target, edits || 'D' AS edits, cost + 2 AS cost, CAST(NULL AS VARCHAR) AS initial, 0 AS stays FROM ins
UNION ALL SELECT source, b, edits || 'R', cost + 1, NULL, 1 FROM ins JOIN (VALUES {new}) AS v(a, b) ON a = here
UNION ALL SELECT source, c, edits || 'K', cost, b, 1 FROM ins JOIN (VALUES {keep}) AS v(a, b, c) ON a = here)"""


OP11 = f"""WITH RECURSIVE {_CRC},
hit AS (SELECT conv_id, turn, CASE WHEN op = 4 THEN 'user' ELSE role END AS role, CASE op WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN op = 3 THEN 2 ELSE 1 END)) AS copy FROM ops WHERE op <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos, left(role, 1) AS initial FROM hit),
f AS MATERIALIZED (SELECT *, CASE WHEN NOT regexp_matches(text, '{BLANK_WORDS}') THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'd' WHEN regexp_matches(text, '[^.!?\x20\x09-\x0D][\x20\x09-\x0D]*$') THEN 't' ELSE '' END AS fault,
lag(role) OVER (PARTITION BY conv_id ORDER BY pos) AS before FROM o),
{_edits()},
walk AS (SELECT DISTINCT conv_id, 0 AS pos, 'E' AS state, 0 AS cost, '' AS audit FROM conversations
UNION ALL SELECT conv_id, pos, state, m.c, m.a FROM (SELECT w.conv_id, f.pos, v.target AS state, min({{'c': w.cost + v.cost + CASE WHEN fault = 't' THEN 5 * stays ELSE 0 END, 'a': w.audit || v.edits}}) AS m
FROM walk w JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.pos = w.pos + 1 JOIN mv v ON v.source = w.state AND (stays = 0 OR fault NOT IN ('b', 'd')) AND (v.initial IS NULL OR v.initial = f.initial) GROUP BY ALL)),
stat AS (SELECT conv_id, max(pos) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
count(*) FILTER (before IS NOT NULL AND left(before, 1) || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY 1),
fin AS (SELECT w.conv_id, min({{'c': cost + length(rest) * 5, 'a': audit || rest}}) AS m FROM walk w LEFT JOIN stat s ON s.conv_id IS NOT DISTINCT FROM w.conv_id JOIN (VALUES ('E', ''), ('A', ''), ('U', 'I'), ('S', 'II')) AS v(st, rest) ON st = w.state WHERE w.pos = coalesce(s.n, 0) GROUP BY 1),
ed AS (SELECT conv_id, unnest(range(1, length(m.a) + 1)) AS i, unnest(string_split(m.a, '')) AS e FROM fin WHERE m.a <> ''),
nu AS (SELECT *, count(*) FILTER (e <> 'I') OVER (PARTITION BY conv_id ORDER BY i) AS pos FROM ed),
ro AS (SELECT nu.*, f.role, f.text, count(*) FILTER (e IN ('R', 'I') OR e = 'K' AND f.initial <> 's') OVER (PARTITION BY nu.conv_id ORDER BY i) AS spoken FROM nu LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM nu.conv_id AND f.pos = nu.pos AND e <> 'I'),
rep AS (SELECT conv_id, string_agg(CASE WHEN e = 'K' THEN role WHEN spoken % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY i) AS told FROM ro WHERE e <> 'D' GROUP BY 1)
SELECT fin.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(fin.m.c AS BIGINT) AS cost, fin.m.a AS audit, sha256(coalesce(told, '')) AS repaired_sha256
FROM fin LEFT JOIN stat s ON s.conv_id IS NOT DISTINCT FROM fin.conv_id LEFT JOIN rep ON rep.conv_id IS NOT DISTINCT FROM fin.conv_id"""

ORACLES = {"op1_substring_dedup": OP1, "op2_line_dedup": OP2, "op6_jaccard_join": OP6, "op8_decontamination": OP8, "op11_conversation_repair": OP11, "op13_centroid_clustering": OP13}
