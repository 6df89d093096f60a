"""DuckDB SQL for those queries that SQL can express."""

from __future__ import annotations

from .licenses import ENDS, RULES, RUNS_ON, SENTENCES, STOPS, rule_text

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP3 = f"""
WITH t AS (SELECT doc_id, {LOWER} AS norm FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g USING (norm)
"""


def _op1() -> str:
    """Known sentences by another way than the operator's one pattern: runs of segments between marks, joined and looked up."""
    known = ", ".join(f"('{text}', '{name}')" for text, name in SENTENCES.items())
    won = []
    for k, (name, sequence) in enumerate(RULES):
        own = rule_text(sequence)
        wider = [rule_text(other) for _, other in RULES if other != sequence and own in rule_text(other)]
        won.append(f"({k}, '{name}', '{own}', {[*wider, 'none']!r})")
    text = f"translate(coalesce(text, ''), '{RUNS_ON}', ' ')"
    for pattern, put in ENDS:
        text = f"regexp_replace({text}, '{pattern}', '{put.replace('$', chr(92))}', 'g')"
    return rf"""
WITH known(norm, sid) AS (VALUES {known}),
rules(k, name, own, wider) AS (VALUES {", ".join(won)}),
marked AS (SELECT row_number() OVER () AS rid, doc_id, '{STOPS}' || translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
parts AS (SELECT rid, unnest(regexp_extract_all(t, '([{STOPS}{RUNS_ON}])([^{STOPS}{RUNS_ON}]*)', 1)) AS mark, unnest(regexp_extract_all(t, '([{STOPS}{RUNS_ON}])([^{STOPS}{RUNS_ON}]*)', 2)) AS seg, generate_subscripts(regexp_extract_all(t, '[{STOPS}{RUNS_ON}]'), 1) AS pos FROM marked),
runs AS (SELECT rid, pos, trim(regexp_replace(seg, '[^a-z0-9]+', ' ', 'g')) AS seg, sum(CASE WHEN mark = '{STOPS}' THEN 1 ELSE 0 END) OVER (PARTITION BY rid ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM parts),
segs AS (SELECT rid, list(seg ORDER BY pos) AS segs, list(pos ORDER BY pos) AS places FROM runs WHERE seg <> '' GROUP BY rid, run),
joined AS (SELECT rid, places[i] AS a, places[i + l] AS b, array_to_string(segs[i:i + l], ' ') AS norm FROM (SELECT *, unnest(range(1, len(segs) + 1)) AS i FROM segs), (SELECT unnest(range(0, 40)) AS l) WHERE i + l <= len(segs)),
best AS (SELECT rid, a, max(b) AS b, arg_max(sid, b) AS sid FROM joined JOIN known USING (norm) GROUP BY rid, a),
picked AS (SELECT rid, list_reduce(list([{{'a': a, 'b': b, 'sid': sid}}] ORDER BY a), lambda acc, x: CASE WHEN x[1].a > acc[-1].b THEN list_concat(acc, x) ELSE acc END) AS hits FROM best GROUP BY rid),
seqs AS (SELECT rid, '|' || array_to_string(list_transform(hits, lambda h: h.sid), '|') || '|' AS ids, len(hits) AS n FROM picked),
named AS (
  SELECT s.rid, r.name, min(r.k) AS k
  FROM seqs s JOIN rules r ON contains(s.ids, r.own) AND NOT list_bool_or(list_transform(r.wider, lambda w: contains(s.ids, w)))
  GROUP BY ALL),
got AS (SELECT rid, string_agg(name, ',' ORDER BY k) AS licenses, count(*) AS n FROM named GROUP BY rid)
SELECT m.doc_id, coalesce(s.n, 0) AS n_known, coalesce(s.ids, '') AS sentence_ids, coalesce(g.licenses, '') AS licenses, coalesce(g.n, 0) AS n_licenses
FROM marked m LEFT JOIN seqs s USING (rid) LEFT JOIN got g USING (rid)
"""


OP7 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT DISTINCT a AS id, a AS m FROM e UNION SELECT e.b, r.m FROM r JOIN e ON e.a = r.id),
f AS (SELECT id, min(m) AS m FROM r GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(f.m, d.doc_id) AS component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN f ON f.id = d.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_scan_licenses": _op1(), "op3_exact_dedup": OP3, "op7_jaccard_join": OP7}
