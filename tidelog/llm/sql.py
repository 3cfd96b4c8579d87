"""DuckDB SQL with the rows of those queries that SQL can express. The others (packing by a vocabulary's ids, contextual patterns,
hashed shuffles, differencing, learned scores) are held against brute force in the tests."""

from __future__ import annotations

_WORDS = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
wi AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d) """

QUALITY = (
    _WORDS
    + r""", win AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS k FROM d, unnest(range(1, greatest(len(w) - 6, 1))) AS r(i)),
again AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win) WHERE c > 1) GROUP BY doc_id),
li AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
ln AS (SELECT doc_id, count(*) AS n_lines, CAST(sum(c) AS BIGINT) AS all_chars, count(*) - count(DISTINCT line) AS n_dup FROM (SELECT *, length(line) AS c FROM li WHERE regexp_matches(line, '[^\x20\x09-\x0D]')) GROUP BY doc_id),
lk AS (SELECT doc_id, CAST(sum(length(line)) AS BIGINT) AS kept_chars FROM (SELECT DISTINCT doc_id, line FROM li WHERE regexp_matches(line, '[^\x20\x09-\x0D]')) GROUP BY doc_id),
m AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(n_lines, 0) AS n_lines, coalesce(n_dup, 0) AS n_dup_lines,
coalesce(all_chars - kept_chars, 0) AS dup_line_chars, coalesce(n, 0) AS n_repeat_words, CAST(len(list_distinct(w)) AS BIGINT) AS n_kinds
FROM d LEFT JOIN again USING (doc_id) LEFT JOIN ln USING (doc_id) LEFT JOIN lk USING (doc_id)),
f AS (SELECT *, CAST((n_words < 20)::INT + 2 * (100 * n_repeat_words > 30 * n_words)::INT + 4 * (10 * n_symbols > n_words)::INT + 8 * (2 * n_dup_lines > n_lines)::INT + 16 * (2 * dup_line_chars > word_chars)::INT
+ 32 * (word_chars < 2 * n_words)::INT + 64 * (word_chars > 25 * n_words)::INT + 128 * (n_words >= 100 AND 20 * n_kinds < n_words)::INT AS BIGINT) AS failures FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, failures = 0 AS kept, failures FROM f"""
)

ABLATIONS = (
    "WITH q AS ("
    + QUALITY
    + """), r AS (SELECT unnest(['few_words', 'repeated_windows', 'symbols', 'repeated_lines', 'repeated_line_chars', 'short_words', 'long_words', 'few_kinds']) AS rule, unnest([1, 2, 4, 8, 16, 32, 64, 128]) AS bit)
SELECT rule, count(*) FILTER (failures & bit <> 0) AS failed, count(*) FILTER (failures = bit) AS failed_alone, count(*) FILTER (failures & ~bit = 0) AS kept_without FROM q, r GROUP BY rule"""
)

SUBSTRINGS = (
    _WORDS
    + r""", win AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS k FROM d, unnest(range(1, greatest(len(w) - 48, 1))) AS r(i)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM (SELECT *, min(doc_id) OVER (PARTITION BY k) AS owner FROM win) WHERE owner < doc_id),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS text FROM wi ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""
)

_REACH = """, e AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs), reach(a, b) AS (SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
comp AS (SELECT a, least(a, min(b)) AS c FROM reach GROUP BY a) """

NEAR_DUPLICATES = (
    r"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS k FROM d, unnest(range(1, greatest(len(w) - 3, 2))) AS r(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.k = y.k AND x.doc_id < y.doc_id GROUP BY 1, 2) p JOIN n u ON u.doc_id = a JOIN n v ON v.doc_id = b WHERE 100 * common >= 75 * (u.n + v.n - common))"""
    + _REACH
    + "SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(c, d.doc_id) AS component_id, coalesce(c, d.doc_id) = d.doc_id AS kept FROM d LEFT JOIN n USING (doc_id) LEFT JOIN comp ON comp.a = d.doc_id"
)

EMBEDDINGS = (
    """WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
pairs AS (SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.vec_id < q.vec_id WHERE list_cosine_similarity(p.x, q.x) >= 0.9)"""
    + _REACH
    + "SELECT v.vec_id, coalesce(n, 0) AS n_links, coalesce(c, v.vec_id) AS component_id, coalesce(c, v.vec_id) = v.vec_id AS kept FROM v LEFT JOIN (SELECT a, count(*) AS n FROM e GROUP BY a) k ON k.a = v.vec_id LEFT JOIN comp ON comp.a = v.vec_id"
)

CHAT = r"""WITH RECURSIVE m AS (SELECT row_number() OVER () AS uid, conv_id, turn, coalesce(role, 'unknown') AS role, string_split(coalesce(text, ''), chr(10)) AS ls FROM conversations),
l AS (SELECT uid, conv_id, turn, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM m),
p AS (SELECT *, length(mk) - length(replace(mk, '>', '')) AS level, lower(trim(regexp_replace(regexp_replace(line, '^[\s>]*', ''), '\s+', ' ', 'g'))) AS norm FROM (SELECT *, regexp_extract(line, '^[\s>]*') AS mk FROM l)),
b AS (SELECT *, CASE WHEN norm <> '' AND lag(norm) OVER w <> '' AND lag(level) OVER w = level THEN 0 ELSE 1 END AS brk FROM p WINDOW w AS (PARTITION BY uid ORDER BY i)),
g AS (SELECT *, sum(brk) OVER (PARTITION BY uid ORDER BY i) AS run FROM b),
r AS (SELECT uid, conv_id, turn, run, level, string_agg(norm, ' ' ORDER BY i) AS folded FROM g WHERE norm <> '' GROUP BY uid, conv_id, turn, run, level),
u AS (SELECT conv_id, turn, norm AS t FROM p WHERE level = 0 AND norm <> '' UNION SELECT conv_id, turn, folded FROM r WHERE level = 0 UNION SELECT conv_id, turn, string_agg(norm, ' ' ORDER BY i) FROM p WHERE level = 0 AND norm <> '' GROUP BY uid, conv_id, turn),
q AS (SELECT x.uid, x.conv_id, x.turn, x.level, coalesce((SELECT max(o.turn) FROM u o WHERE o.conv_id = x.conv_id AND o.t = x.norm AND o.turn < x.turn), (SELECT max(o.turn) FROM u o WHERE o.conv_id = x.conv_id AND o.t = r.folded AND o.turn < x.turn)) AS to_turn
FROM g x JOIN r ON r.uid = x.uid AND r.run = x.run WHERE x.level > 0 AND x.norm <> ''),
votes AS (SELECT uid, conv_id, turn, to_turn, count(*) AS n FROM q WHERE level = 1 AND to_turn IS NOT NULL GROUP BY ALL),
par AS (SELECT uid, conv_id, turn, arg_max(to_turn, n * 1000000 + to_turn) AS parent FROM votes GROUP BY ALL),
chain(uid, conv_id, up) AS (SELECT uid, conv_id, parent FROM par UNION SELECT chain.uid, chain.conv_id, par.parent FROM chain JOIN par ON par.conv_id = chain.conv_id AND par.turn = chain.up),
root AS (SELECT uid, min(up) AS root FROM chain GROUP BY uid),
st AS (SELECT uid, max(level) AS max_level, count(*) AS n_quoted, count(to_turn) AS n_linked FROM q GROUP BY uid),
own AS (SELECT uid, string_agg(line, chr(10) ORDER BY i) FILTER (level = 0) AS body, count(*) FILTER (level > 0) AS quoted FROM p GROUP BY uid),
o AS (SELECT m.*, parent, coalesce(root, m.turn) AS root_turn, coalesce(max_level, 0) AS max_level, coalesce(n_quoted, 0) AS n_quoted, coalesce(n_linked, 0) AS n_linked,
CASE WHEN quoted > 0 THEN regexp_replace(coalesce(body, ''), '^\s+|\s+$', '', 'g') ELSE coalesce(body, '') END AS text
FROM m LEFT JOIN par USING (uid) LEFT JOIN root USING (uid) LEFT JOIN st USING (uid) LEFT JOIN own USING (uid))
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY root_turn, turn, uid) - 1 AS position, turn, role, parent AS parent_turn, root_turn, CAST(max_level AS BIGINT) AS max_level, n_quoted, n_linked, text,
'<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS formatted FROM o"""

SQL = {
    "op4_chat_formatting": CHAT,
    "op5_substring_dedup": SUBSTRINGS,
    "op6_embedding_dedup": EMBEDDINGS,
    "op7_minhash": NEAR_DUPLICATES,
    "op9_quality_rules": QUALITY,
    "quality_ablations": ABLATIONS,
}
