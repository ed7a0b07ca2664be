"""DuckDB SQL for the operators whose results SQL can state."""

from __future__ import annotations

from quire.llm.licences import TEMPLATES, THRESHOLD
from quire.llm.vectorcodes import ENTRIES, PARTS, ROUNDS, SCALE

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

NEAR_DUPLICATES = rf"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, sh FROM (SELECT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS sh FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(node, comp) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.y, r.comp FROM r JOIN e ON e.x = r.node),
c AS (SELECT node, min(comp) AS component_id FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN c ON c.node = d.doc_id"""

REPEATS = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS hx, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, unnest(range(0, greatest(n - 399, 0))) AS p, hx FROM d), h AS (SELECT doc_id, p, md5(substring(hx, 2 * p + 1, 800)) AS m FROM w),
k AS (SELECT m FROM h GROUP BY m HAVING count(*) > 1), s AS (SELECT h.doc_id, h.p FROM h JOIN k ON k.m = h.m),
g AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 400 THEN 0 ELSE 1 END AS new FROM s), i AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM g),
r AS (SELECT doc_id, run, min(p) AS a, max(p) + 400 AS b FROM i GROUP BY doc_id, run),
o AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS x, a AS y FROM r UNION ALL SELECT doc_id, max(b), NULL FROM r GROUP BY doc_id),
q AS (SELECT d.doc_id, string_agg(substring(d.hx, 2 * o.x + 1, 2 * (coalesce(o.y, d.n) - o.x)), '' ORDER BY o.x) AS kept FROM d JOIN o ON o.doc_id = d.doc_id GROUP BY d.doc_id), t AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans FROM r GROUP BY doc_id)
SELECT d.doc_id, d.n::BIGINT AS n_bytes, coalesce(t.removed, 0)::BIGINT AS n_removed, coalesce(t.spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(q.kept, d.hx))) AS kept_sha256 FROM d LEFT JOIN t ON t.doc_id = d.doc_id LEFT JOIN q ON q.doc_id = d.doc_id"""

_VALUES = ", ".join(f"('{name}', '{text}', {i})" for i, (name, text) in enumerate(TEMPLATES))
_PART = "'/' || coalesce({}::VARCHAR, '_')"
_PATH = f"""{_PART.format('source')} || CASE WHEN doc_id % 500 < 20 THEN '' ELSE {_PART.format('lang')} END || CASE WHEN doc_id % 100 < 20 THEN '' ELSE {_PART.format('(doc_id // 100)')} END
 || CASE WHEN doc_id % 10 = 4 THEN '/LICENSE.' || doc_id ELSE {_PART.format('doc_id')} END"""
_TERMS = "regexp_split_to_array(lower({}), '[^a-z0-9]+')"
_JOINED = "CASE WHEN len(ls) >= {0} THEN list_transform(range(1, len(ls) - {0} + 2), lambda i: array_to_string(ls[i:i + {0} - 1], ' ')) ELSE [] END"
LICENCES = rf"""WITH tpl(licence, body, no) AS (VALUES {_VALUES}), tt AS (SELECT licence, no, unnest({_TERMS.format('body')}) AS term FROM tpl), tf AS (SELECT licence, no, term, count(*) AS tf FROM tt WHERE term <> '' GROUP BY ALL),
total AS (SELECT count(*) AS n FROM documents), dw AS (SELECT DISTINCT doc_id, unnest({_TERMS.format("coalesce(text, '')")}) AS term FROM documents), df AS (SELECT term, count(*) AS df FROM dw WHERE term IN (SELECT term FROM tf) GROUP BY term),
idf AS (SELECT DISTINCT tf.term, ln((1 + n) / (1 + coalesce(df, 0))) + 1 AS idf FROM tf CROSS JOIN total LEFT JOIN df ON df.term = tf.term), tn AS (SELECT tf.no, sqrt(sum((tf * idf) ** 2)) AS norm FROM tf JOIN idf ON idf.term = tf.term GROUP BY tf.no),
tv AS (SELECT tf.licence, tf.no, tf.term, tf * idf / norm AS w FROM tf JOIN idf ON idf.term = tf.term JOIN tn ON tn.no = tf.no),
files AS (SELECT doc_id, {_PATH} AS path, coalesce(text, '') AS text FROM documents), sl AS (SELECT path, text, string_split_regex(text, '\r\n|\n|\r') AS ls FROM files),
fl AS (SELECT DISTINCT path, unnest(list_concat(ls, {_JOINED.format(2)}, {_JOINED.format(3)}, string_split_regex(text, '(\r\n|\n|\r)[ \t]*(\r\n|\n|\r)'), CASE WHEN contains(path, '/LICENSE.') THEN [text] ELSE [] END)) AS unit FROM sl), us AS (SELECT DISTINCT unit FROM fl),
lw AS (SELECT unit, unnest({_TERMS.format('unit')}) AS term FROM us), lf AS (SELECT unit, term, count(*) AS tf FROM lw WHERE term <> '' GROUP BY ALL), lx AS (SELECT lf.unit, lf.term, lf.tf * coalesce(idf.idf, ln(1 + n) + 1) AS x FROM lf CROSS JOIN total LEFT JOIN idf ON idf.term = lf.term),
ln_ AS (SELECT unit, sqrt(sum(x * x)) AS norm FROM lx GROUP BY unit), dot AS (SELECT lx.unit, tv.licence, tv.no, sum(lx.x * tv.w) AS dot FROM lx JOIN tv ON tv.term = lx.term GROUP BY ALL HAVING count(*) > 1),
sc AS (SELECT dot.unit, dot.licence, round(dot.dot / ln_.norm, 6) AS score FROM dot JOIN ln_ ON ln_.unit = dot.unit), ub AS (SELECT unit, licence, score FROM sc WHERE score >= {THRESHOLD} QUALIFY row_number() OVER (PARTITION BY unit ORDER BY score DESC, licence) = 1),
own AS (SELECT fl.path, ub.licence, ub.score FROM fl JOIN ub ON ub.unit = fl.unit QUALIFY row_number() OVER (PARTITION BY fl.path ORDER BY ub.score DESC, ub.licence) = 1),
sp AS (SELECT regexp_replace(path, '/[^/]*$', '') AS dir, licence FROM own QUALIFY row_number() OVER (PARTITION BY regexp_replace(path, '/[^/]*$', '') ORDER BY score DESC, path) = 1),
ds AS (SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS dir FROM files), nearest AS (SELECT ds.dir, sp.dir AS licence_dir, sp.licence FROM ds JOIN sp ON sp.dir = ds.dir OR starts_with(ds.dir, sp.dir || '/') QUALIFY row_number() OVER (PARTITION BY ds.dir ORDER BY length(sp.dir) DESC) = 1)
SELECT f.doc_id, f.path, coalesce(own.licence, a.licence) AS licence, own.score, CASE WHEN own.licence IS NOT NULL THEN 'own' WHEN a.licence IS NOT NULL THEN 'inherited' ELSE 'none' END AS how, CASE WHEN own.licence IS NULL THEN a.licence_dir END AS licence_dir
FROM files f LEFT JOIN own ON own.path = f.path LEFT JOIN nearest a ON a.dir = regexp_replace(f.path, '/[^/]*$', '')"""

_BARE = r"chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
LINES = f"""WITH t AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS pos, unnest(ls) AS line FROM t), k AS (SELECT doc_id, pos, line, translate(trim(line, {_BARE}), '{_UPPER}', '{_LOWER}') AS key FROM l),
c AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) + CAST(count(*) > count(doc_id) AS INTEGER) >= 5)
SELECT k.doc_id, count(*)::BIGINT AS n_lines, count(c.key) FILTER (WHERE k.doc_id IS DISTINCT FROM c.keeper)::BIGINT AS n_dropped,
 sha256(coalesce(string_agg(k.line, chr(10) ORDER BY pos) FILTER (WHERE c.key IS NULL OR k.doc_id IS NOT DISTINCT FROM c.keeper), '')) AS kept_sha256 FROM k LEFT JOIN c ON c.key = k.key GROUP BY k.doc_id"""


def _codes() -> str:
    """Every round of the codebooks as two steps: assignments by exact distance, then floors of means; equal parts all through."""
    steps = []
    for k in range(ROUNDS + 1):
        steps.append(f"""d{k} AS MATERIALIZED (SELECT x.vec_id, x.part, b.entry, sum((x.v - b.v) * (x.v - b.v)) AS far FROM x JOIN b{k} b ON b.part = x.part AND b.place = x.place GROUP BY ALL),
a{k} AS MATERIALIZED (SELECT vec_id, part, entry, far FROM d{k} QUALIFY row_number() OVER (PARTITION BY vec_id, part ORDER BY far, entry) = 1)""")
        if k < ROUNDS:
            steps.append(f"""m{k} AS (SELECT x.part, a.entry, x.place, sum(x.v)::BIGINT AS s, count(*) AS n FROM x JOIN a{k} a ON a.vec_id = x.vec_id AND a.part = x.part GROUP BY ALL),
b{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, b.place, coalesce((s - (s % n + n) % n) // n, b.v) AS v FROM b{k} b LEFT JOIN m{k} m ON m.part = b.part AND m.entry = b.entry AND m.place = b.place)""")
    return f"""WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda y: floor({SCALE} * y::DOUBLE)::BIGINT) AS v, len(embedding) // {PARTS} AS w FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
x AS MATERIALIZED (SELECT vec_id, (i - 1) // w AS part, (i - 1) % w AS place, v[i] AS v FROM (SELECT vec_id, w, v, unnest(range(1, len(v) + 1)) AS i FROM kept)),
f AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT {ENTRIES}), b0 AS MATERIALIZED (SELECT x.part, f.entry, x.place, x.v FROM x JOIN f ON f.vec_id = x.vec_id),
{", ".join(steps)},
c AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(far)::BIGINT AS error FROM a{ROUNDS} GROUP BY vec_id), s AS (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY part, entry, place)) AS h FROM b{ROUNDS}),
t AS (SELECT k.vec_id, k.label, c.code, c.error FROM kept k JOIN c ON c.vec_id = k.vec_id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, s.h AS codebooks_sha256 FROM t CROSS JOIN s"""


CODES = _codes()


_BITS = "list_concat([4294967295], flatten(list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda i: [ascii(substring(conv_id::VARCHAR, i, 1))::BIGINT, 0, 0, 0, 0, 0, 0, 0])))"
_CRC = f"xor(list_reduce({_BITS}, lambda a, e: CASE WHEN xor(a, e) & 1 = 1 THEN xor(xor(a, e) >> 1, 3988292384) ELSE xor(a, e) >> 1 END), 4294967295)"
PREFIXES = f"""WITH t AS (SELECT conv_id, turn, octet_length(encode(coalesce(text, '')))::BIGINT AS bytes, md5(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')) AS m FROM conversations WHERE conv_id IS NOT NULL),
s AS (SELECT conv_id, list(m ORDER BY turn NULLS FIRST, m) AS ms, list(bytes ORDER BY turn NULLS FIRST, m) AS bs FROM t GROUP BY conv_id), h AS (SELECT *, conv_id - conv_id % 5 AS base, {_CRC} % 9 AS h FROM s),
r AS (SELECT h.conv_id, list_concat(coalesce(b.ms[1:h.h], []), h.ms[h.h + 1:]) AS ms, list_concat(coalesce(b.bs[1:h.h], []), h.bs[h.h + 1:]) AS bs FROM h LEFT JOIN s b ON b.conv_id = h.base),
p AS (SELECT conv_id, d, md5(array_to_string(ms[1:d], ',')) AS k, md5(array_to_string(ms[1:d - 1], ',')) AS q, coalesce(bs[d], 0) AS bytes, d = len(ms) AS stop FROM (SELECT *, unnest(range(0, len(ms) + 1)) AS d FROM r)),
n AS (SELECT k, d, min(q) AS q, min(conv_id) AS conv_id, count(*) AS n, min(bytes) AS bytes, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE stop), '')) AS ends FROM p GROUP BY k, d),
c AS (SELECT n.*, (SELECT count(*) FROM n x WHERE x.q = n.k AND x.d = n.d + 1) AS kids FROM n),
a AS (SELECT p.k, p.d, sum(CASE WHEN c.kids = 0 THEN 1 ELSE 0 END) AS leaves, sum((c.n - 1) * c.bytes) AS saved FROM c JOIN p ON p.conv_id = c.conv_id AND p.d <= c.d GROUP BY p.k, p.d)
SELECT c.conv_id, c.d::BIGINT AS depth, u.conv_id AS parent_conv_id, c.n::BIGINT AS n_convs, c.kids::BIGINT AS n_children, a.leaves::BIGINT AS n_leaves, a.saved::BIGINT AS saved_tokens, c.ends AS ends_sha256
FROM c JOIN a ON a.k = c.k AND a.d = c.d LEFT JOIN n u ON u.k = c.q AND u.d = c.d - 1"""
