"""Queries and oracle SQL of the training-data operators."""

from __future__ import annotations

from pathsieve.llm.byte_bpe import op9_byte_bpe
from pathsieve.llm.conversations import op11_conversation_repair
from pathsieve.llm.decontaminate import op3_decontaminate
from pathsieve.llm.html_text import op8_html_text
from pathsieve.llm.line_dedup import op13_line_dedup
from pathsieve.llm.merkle import op12_merkle_manifest
from pathsieve.llm.ngram_join import op7_ngram_join
from pathsieve.llm.nn_descent import op1_nn_descent
from pathsieve.llm.quality import op4_quality
from pathsieve.llm.sharding import op5_sharding
from pathsieve.llm.substring_dedup import op10_substring_dedup
from pathsieve.llm.suffix_dedup import op6_suffix_dedup
from pathsieve.llm.token_counts import op2_token_counts


def queries() -> dict:
    return {
        "op1_nn_descent": op1_nn_descent,
        "op2_token_counts": op2_token_counts,
        "op3_decontaminate": op3_decontaminate,
        "op4_quality": op4_quality,
        "op5_sharding": op5_sharding,
        "op6_suffix_dedup": op6_suffix_dedup,
        "op7_ngram_join": op7_ngram_join,
        "op8_html_text": op8_html_text,
        "op9_byte_bpe": op9_byte_bpe,
        "op10_substring_dedup": op10_substring_dedup,
        "op11_conversation_repair": op11_conversation_repair,
        "op12_merkle_manifest": op12_merkle_manifest,
        "op13_line_dedup": op13_line_dedup,
    }


WORDS = r"list_filter(string_split_regex({text}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
c(vec_id, r) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, c.r FROM c JOIN l ON l.a = c.vec_id),
m AS (SELECT vec_id, min(r) AS component_id FROM c GROUP BY 1),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY 1)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept, 1.0::DOUBLE AS recall FROM m LEFT JOIN n USING (vec_id)"""

OP7_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(text=LOWER)} AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS sh FROM w),
e AS (SELECT doc_id, unnest(sh) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN s sa ON sa.doc_id = a JOIN s sb ON sb.doc_id = b WHERE 100 * n >= 90 * (len(sa.sh) + len(sb.sh) - n)),
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
c(doc_id, r) AS (SELECT doc_id, doc_id FROM s UNION SELECT u.b, c.r FROM c JOIN u ON u.a = c.doc_id)
SELECT s.doc_id, len(any_value(sh)) AS n_shingles, min(r) AS component_id FROM s JOIN c USING (doc_id) GROUP BY s.doc_id"""

OP10_SQL = f"""
WITH w AS (SELECT doc_id, {WORDS.format(text="coalesce(text, '')")} AS ws FROM documents),
k AS (SELECT doc_id, p, array_to_string(ws[p:p + 12], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS p FROM w WHERE len(ws) >= 13)),
f AS (SELECT k, min(doc_id) AS first_doc FROM k GROUP BY 1),
g AS (SELECT doc_id, list_distinct(flatten(list(range(p, p + 13)))) AS gone FROM k JOIN f USING (k) WHERE first_doc < doc_id GROUP BY 1)
SELECT w.doc_id, len(ws) AS n_words, len(coalesce(gone, [])) AS n_removed,
    sha256(array_to_string(list_filter(ws, lambda x, i: NOT list_contains(coalesce(gone, []), i)), ' ')) AS kept_sha256 FROM w LEFT JOIN g USING (doc_id)"""

#: Unsigned CRC-32 of ASCII text.
CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: list_reduce([xor(c, b), 1, 1, 1, 1, 1, 1, 1, 1], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"

#: Cheapest (cost, audit) of the turns from each on, by what was written before: nothing, system, user, assistant.
_STEP = """least({{'c': n.{q}.c + 2, 'a': 'D' || n.{q}.a}}, CASE WHEN fault IN (0, 3) THEN {{'c': n.{to}.c + 1 + more, 'a': 'R' || n.{to}.a}} END,
    CASE WHEN fault IN (0, 3) AND initial = '{letter}' THEN {{'c': n.{to}.c + more, 'a': 'K' || n.{to}.a}} END{system})"""
_INSERT = "least({q}, {{'c': {to}.c + 5, 'a': 'I' || {to}.a}}) AS {q}"
_FOLLOWS = {"s0": "su", "ss": "su", "su": "sa", "sa": "su"}
_LETTER = {"su": "u", "sa": "a"}
_STEPS = ", ".join(
    _STEP.format(q=q, to=to, letter=_LETTER[to], system=", CASE WHEN fault IN (0, 3) AND initial = 's' THEN {'c': n.ss.c + more, 'a': 'K' || n.ss.a} END" if q == "s0" else "") + f" AS {q}"
    for q, to in _FOLLOWS.items()
)
_INSERTS = ", ".join(_INSERT.format(q=q, to=to) for q, to in _FOLLOWS.items())
OP11_SQL = rf"""
WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {CRC.format(text="coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind FROM conversations),
d AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS again FROM c WHERE kind <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS rest, role[1:1] AS initial FROM d),
f AS (SELECT *, CASE WHEN rest = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY p) > 1 THEN 2 WHEN right(rest, 1) IN ('.', '!', '?') THEN 0 ELSE 3 END AS fault, count(*) OVER (PARTITION BY conv_id) AS n,
    coalesce(lag(initial) OVER (PARTITION BY conv_id ORDER BY p) || initial NOT IN ('su', 'ua', 'au'), false) AS illegal FROM o),
w(conv_id, p, s0, ss, su, sa) AS (
    SELECT conv_id, count(*) + 1, {{'c': 0::BIGINT, 'a': ''}}, {{'c': 10::BIGINT, 'a': 'II'}}, {{'c': 5::BIGINT, 'a': 'I'}}, {{'c': 0::BIGINT, 'a': ''}} FROM f GROUP BY 1
    UNION ALL
    SELECT conv_id, p, {_INSERTS} FROM (SELECT conv_id, p, {_INSERTS} FROM (
        SELECT f.conv_id, f.p, CASE fault WHEN 3 THEN 5 ELSE 0 END AS more, {_STEPS} FROM w n JOIN f ON f.conv_id IS NOT DISTINCT FROM n.conv_id AND f.p = n.p - 1))),
a AS (SELECT conv_id, s0.c AS cost, s0.a AS audit FROM w WHERE p = 1),
e AS (SELECT conv_id, unnest(string_split(audit, '')) AS edit, generate_subscripts(string_split(audit, ''), 1) AS k, length(replace(audit, 'D', '')) % 2 AS system FROM a),
x AS (SELECT *, count(*) FILTER (edit <> 'I') OVER (PARTITION BY conv_id ORDER BY k) AS p, count(*) FILTER (edit <> 'D') OVER (PARTITION BY conv_id ORDER BY k) - 1 AS written FROM e),
r AS (SELECT x.conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (written - system) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || CASE edit WHEN 'I' THEN '' ELSE text END, chr(10) ORDER BY k) FILTER (edit <> 'D') AS said
    FROM x LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM x.conv_id AND f.p = x.p GROUP BY 1),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (illegal) AS illegal FROM f GROUP BY 1)
SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(said, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN a ON a.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM i.conv_id"""

_PART = "coalesce(strlen({x}::VARCHAR) || ':' || {x}::VARCHAR, '-')"
_LEAF = "sha256(" + " || ".join(_PART.format(x=x) for x in ("doc_id", "source", "lang", "n_chars", "{text}")) + ")"
#: A tree's levels, and the way of a node up to its top with its siblings on the way.
_TREE = "SELECT g, 0 AS lvl, i, h FROM {nodes} UNION ALL SELECT g, lvl + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)) FROM (SELECT *, count(*) OVER (PARTITION BY g) AS own FROM {tree}) WHERE own > 1 GROUP BY g, lvl, i // 8"
_CLIMB = """SELECT id, g, 0 AS lvl, i, h, sib FROM {nodes} UNION ALL
    SELECT u.id, u.g, u.lvl + 1, u.i // 8, sha256(string_agg(CASE WHEN t.i = u.i THEN u.h ELSE t.h END, '' ORDER BY t.i)), u.sib || coalesce(string_agg(t.h, '' ORDER BY t.i) FILTER (t.i <> u.i), '')
    FROM {up} u JOIN {tree} t ON t.g = u.g AND t.lvl = u.lvl AND t.i // 8 = u.i // 8 JOIN (SELECT g, max(lvl) AS high FROM {tree} GROUP BY 1) m ON m.g = u.g AND u.lvl < high GROUP BY u.id, u.g, u.lvl, u.i, u.h, u.sib"""
OP12_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce('=' || lang, '') AS g, {_LEAF.format(text="text")} AS leaf,
    CASE WHEN {CRC.format(text="doc_id::VARCHAR")} % 3 = 0 THEN {_LEAF.format(text="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS other FROM documents),
l AS (SELECT doc_id AS id, g, row_number() OVER (PARTITION BY g ORDER BY doc_id) - 1 AS i, leaf AS h, coalesce(other, leaf) AS changed FROM d),
t AS ({_TREE.format(nodes="l", tree="t")}),
s AS (SELECT 0 AS g, g AS name, h, row_number() OVER (ORDER BY g) - 1 AS i FROM (SELECT g, h FROM t QUALIFY lvl = max(lvl) OVER (PARTITION BY g))),
r AS ({_TREE.format(nodes="s", tree="r")}),
lc AS (SELECT id, g, i, changed AS h, '' AS sib FROM l),
u AS ({_CLIMB.format(nodes="lc", up="u", tree="t")}),
sc AS (SELECT u.id, 0 AS g, s.i, u.h, u.sib FROM u JOIN s ON s.name = u.g JOIN (SELECT g, max(lvl) AS high FROM t GROUP BY 1) m ON m.g = u.g AND u.lvl = high),
v AS ({_CLIMB.format(nodes="sc", up="v", tree="r")}),
top AS (SELECT h AS root, lvl FROM r ORDER BY lvl DESC LIMIT 1)
SELECT l.id AS doc_id, l.h AS leaf, s.h AS subroot, root, sha256(v.sib) AS proof_sha256, v.h AS folded_root, v.h = root AS verified
FROM l JOIN s ON s.name = l.g JOIN v ON v.id = l.id JOIN top ON v.lvl = top.lvl"""

OP13_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS p FROM documents),
k AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY 1 HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.doc_id, p, line, coalesce(k.doc_id < last, false) AS gone FROM k LEFT JOIN c USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM m GROUP BY 1"""


def oracle_sql() -> dict[str, str]:
    return {"op1_nn_descent": OP1_SQL, "op7_ngram_join": OP7_SQL, "op10_substring_dedup": OP10_SQL, "op11_conversation_repair": OP11_SQL, "op12_merkle_manifest": OP12_SQL, "op13_line_dedup": OP13_SQL}
