"""DuckDB SQL for the operators that SQL can express.

The others are checked in tests/llm: op1's takings follow a hash that DuckDB has not, op2 and
op8 need the tokenizers, op3, op4, op5 and op9 a procedure, op7 writes and reads files.
"""


def _crc_nibbles() -> list[int]:
    out = list(range(16))
    for _ in range(4):
        out = [(c >> 1) ^ 0xEDB88320 if c & 1 else c >> 1 for c in out]
    return out


def _crc32(x: str) -> str:
    """The CRC-32 of a text's bytes, half a byte at a time: DuckDB has no function for it."""
    h = f"hex(encode({x}))"
    bits = f"list_transform(range(len({h})), lambda i: CAST(strpos('0123456789ABCDEF', substr({h}, xor(i, 1) + 1, 1)) - 1 AS BIGINT))"
    return f"xor(list_reduce({bits}, lambda c, b: xor(c >> 4, {_crc_nibbles()}[(xor(c, b) & 15) + 1]), CAST(4294967295 AS BIGINT)), 4294967295)"


def _runs(table: str) -> str:
    """The words of each text, and its runs of one to three."""
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = rf"SELECT *, regexp_extract_all({lower}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM {table}"
    two, three = "list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])", "list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])"
    return f"SELECT *, list_concat(w, {two}, {three}) AS runs FROM ({words})"


def _add(x: str, cost: str, letter: str) -> str:
    """A cost of nine digits and its audit, after one edit more in front."""
    return f"(lpad(CAST(CAST({x}[1:9] AS INTEGER) + {cost} AS VARCHAR), 9, '0') || '{letter}' || {x}[10:])"


def _repairs() -> str:
    """The step from the states after a row (a0 to a3: nothing, system, user or assistant last) to those before it."""
    anew, kept = (2, 2, 3, 2), {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
    on = []
    for p in range(4):
        keep = "".join(f" WHEN '{c}' THEN {_add(f'a{q[p]}', 'late', 'K')}" for c, q in kept.items() if p in q)
        keep = f"CASE WHEN gone THEN '9' WHEN true THEN CASE code{keep} ELSE '9' END END" if keep else "'9'"
        on.append(f"least({_add(f'a{p}', '2', 'D')}, {keep}, CASE WHEN gone THEN '9' ELSE {_add(f'a{anew[p]}', '1 + late', 'R')} END)")
    inserted = [f"least(b{p}, {_add(f'b{anew[p]}', '5', 'I')}, {_add(_add(f'b{anew[anew[p]]}', '5', 'I'), '5', 'I')}) AS a{p}" for p in range(4)]
    return f"SELECT conv_id, i, {', '.join(inserted)} FROM (SELECT conv_id, i, {', '.join(f'{x} AS b{p}' for p, x in enumerate(on))} FROM (SELECT d.conv_id, f.i, code, gone, late, a0, a1, a2, a3 FROM d JOIN f ON f.conv_id IS NOT DISTINCT FROM d.conv_id AND f.i = d.i - 1))"


_CLOSURE = "r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)"

SQL: dict[str, str] = {
    "op6_jaccard": rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM g x JOIN g y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 90 * (x.n + y.n - shared)),
{_CLOSURE}, c AS (SELECT a, min(b) AS least FROM r GROUP BY a)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, least(w.doc_id, coalesce(least, w.doc_id)) AS component_id FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN c ON c.a = w.doc_id""",
    "op10_embed": f"""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
f AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM f x JOIN f y ON x.label = y.label AND x.vec_id <> y.vec_id WHERE list_cosine_similarity(x.e, y.e) >= 0.93),
{_CLOSURE}, c AS (SELECT a, min(b) AS least FROM r GROUP BY a), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(least, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(least, vec_id)) AS kept FROM v LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id""",
    "op11_resample": f"""
WITH w AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, len(w) AS n_words, runs FROM ({_runs("documents")})),
f AS (SELECT r, unnest(runs) AS f FROM w), g AS (SELECT unnest(runs) AS f FROM ({_runs("benchmark")})),
b AS MATERIALIZED (SELECT f, {_crc32("f")} % 10000 AS b FROM (SELECT f FROM f UNION SELECT f FROM g)),
s AS (SELECT b, count(*) AS s FROM f JOIN b USING (f) GROUP BY b), t AS (SELECT b, count(*) AS t FROM g JOIN b USING (f) GROUP BY b),
n AS (SELECT (SELECT count(*) FROM f) AS s, (SELECT count(*) FROM g) AS t),
k AS (SELECT s.b, CAST(floor(1000 * ln((coalesce(t.t, 0) + 1)::DOUBLE * (n.s + 10000) / ((s.s + 1)::DOUBLE * (n.t + 10000)))) AS BIGINT) AS gain FROM s LEFT JOIN t ON t.b = s.b CROSS JOIN n),
d AS (SELECT r, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS weight FROM f JOIN b USING (f) JOIN k USING (b) GROUP BY r),
x AS (SELECT w.r, doc_id, n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, CAST('0x' || substr(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h FROM w LEFT JOIN d USING (r)),
y AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM x),
z AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM y WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT 5 * count(*) // 100 FROM z) THEN rank END AS rank FROM y LEFT JOIN z USING (r)""",
    "op12_repair": rf"""
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS k FROM conversations),
e AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE k WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM k),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank FROM e),
m AS (SELECT *, NOT blank AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM o),
f AS MATERIALIZED (SELECT *, role[1] AS code, blank OR again AS gone, NOT blank AND NOT again AND NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS truncated, CASE WHEN truncated THEN 5 ELSE 0 END AS late FROM m),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again) AS duplicate, count(*) FILTER (truncated) AS truncated, count(*) FILTER (before IS NOT NULL AND before || code NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM f GROUP BY conv_id),
d AS (SELECT conv_id, n + 1 AS i, '000000000' AS a0, '000000010II' AS a1, '000000005I' AS a2, '000000000' AS a3 FROM c UNION ALL {_repairs()}),
s AS (SELECT conv_id, CAST(a0[1:9] AS BIGINT) AS cost, a0[10:] AS audit FROM d WHERE i = 1),
l AS (SELECT conv_id, unnest(string_split(audit, '')) AS edit, unnest(range(1, len(audit) + 1)) AS j FROM s WHERE audit <> ''),
p AS (SELECT *, count(*) FILTER (edit <> 'I') OVER w AS i, count(*) FILTER (edit <> 'D') OVER w AS place FROM l WINDOW w AS (PARTITION BY conv_id ORDER BY j)),
q AS (SELECT p.*, f.role, f.text, CASE WHEN edit = 'K' AND code = 's' THEN 1 ELSE 0 END AS system FROM p LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.i AND edit <> 'I' WHERE edit <> 'D'),
r AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (place - (SELECT max(system) FROM q x WHERE x.conv_id IS NOT DISTINCT FROM q.conv_id)) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY j) AS t FROM q GROUP BY conv_id)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM a.conv_id""",
}
