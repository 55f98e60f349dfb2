"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from siftlog.llm.license_texts import EQUIVALENT_SPELLINGS, LICENSE_TEXTS
from siftlog.llm.licenses import COPYRIGHT_LINE

ORACLE: dict[str, str] = {}

_WORD = r"'[^\x20\x09-\x0D]+'"

ORACLE["op7_mixing"] = rf"""
WITH d AS (
  SELECT doc_id, coalesce(len(regexp_extract_all(text, {_WORD})), 0)::BIGINT AS size,
    CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS k, md5('0:' || coalesce(doc_id::VARCHAR, 'null')) AS place
  FROM documents),
s0 AS (SELECT k, sum(size)::BIGINT AS source_size, count(*) AS n FROM d GROUP BY k),
s1 AS (SELECT *, (row_number() OVER (ORDER BY k) - 1) % 3 + 1 AS w, sum(source_size) OVER ()::BIGINT AS total FROM s0),
s2 AS (SELECT *, 3 * source_size / w AS full_at, sum(w) OVER () AS ws FROM s1),
s3 AS (SELECT *, (total - coalesce(sum(3 * source_size) OVER before, 0))::DOUBLE / (ws - coalesce(sum(w) OVER before, 0))::DOUBLE AS lvl
  FROM s2 WINDOW before AS (ORDER BY full_at, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s4 AS (SELECT *, CASE WHEN lvl < full_at THEN max(CASE WHEN lvl < full_at THEN lvl END) OVER () * w ELSE (3 * source_size)::DOUBLE END AS target,
  greatest(1, least(2048, total // 1048576)) AS b FROM s3),
s5 AS (SELECT *, floor(total / b + 0.5)::BIGINT AS seats, ceil(n / 5000)::BIGINT AS shards FROM s4),
s6 AS (SELECT *, CASE WHEN total > 0 THEN floor(target * seats / total + 0.5) ELSE 0 END::BIGINT AS seat FROM s5),
s7 AS (SELECT *, CASE WHEN total > 0 THEN seats - sum(seat) OVER () ELSE 0 END AS off FROM s6),
q1 AS (SELECT k, off, row_number() OVER (ORDER BY CASE WHEN off > 0 THEN target / (2 * (seat + i) + 1)
    ELSE -target / (2 * (seat - i) - 1) END DESC, k, i) AS r
  FROM s7, range(0, 64) AS t(i) WHERE i < abs(off) AND (off > 0 OR seat - i >= 1)),
s8 AS (SELECT s7.*, seat + coalesce((SELECT sum(sign(q1.off)) FROM q1 WHERE q1.k = s7.k AND r <= abs(q1.off)), 0) AS quota FROM s7),
e AS (SELECT d.*, s8.source_size, s8.target, s8.b, s8.quota, ('0x' || substr(place, 1, 8))::BIGINT % s8.shards AS shard
  FROM d JOIN s8 USING (k)),
h0 AS (SELECT k, shard, sum(size)::BIGINT AS words, any_value(source_size) AS source_size, any_value(b) AS b,
    any_value(quota) AS quota FROM e GROUP BY k, shard),
h1 AS (SELECT *, CASE WHEN source_size > 0 THEN floor(words * quota / source_size + 0.5) ELSE 0 END::BIGINT AS seat FROM h0),
h2 AS (SELECT *, CASE WHEN source_size > 0 THEN quota - sum(seat) OVER (PARTITION BY k) ELSE 0 END AS off FROM h1),
q2 AS (SELECT k, shard, off, row_number() OVER (PARTITION BY k ORDER BY CASE WHEN off > 0 THEN words / (2 * (seat + i) + 1)
    ELSE -words / (2 * (seat - i) - 1) END DESC, shard, i) AS r
  FROM h2, range(0, 64) AS t(i) WHERE i < abs(off) AND (off > 0 OR seat - i >= 1)),
h3 AS (SELECT h2.k, h2.shard, words, least(b * (seat + coalesce((SELECT sum(sign(q2.off)) FROM q2
    WHERE q2.k = h2.k AND q2.shard = h2.shard AND r <= abs(q2.off)), 0)), 3 * words)::BIGINT AS wanted FROM h2),
o AS (SELECT e.*, words, wanted, sum(size) OVER (PARTITION BY e.k, e.shard ORDER BY place, doc_id NULLS FIRST, size
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS before
  FROM e JOIN h3 ON e.k = h3.k AND e.shard = h3.shard)
SELECT doc_id, size, source_size, target,
  CASE WHEN words > 0 THEN wanted // words * size + greatest(0, least(size, wanted % words - before)) ELSE 0 END::BIGINT AS taken
FROM o
"""

ORACLE["op8_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
r AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS first,
  row_number() OVER (PARTITION BY h ORDER BY page_id DESC NULLS LAST) AS n FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, (i // 4) * 5 + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT + 1, 1)
  ), '') AS payload_digest,
  CASE WHEN n = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN n = 1 THEN NULL ELSE first END AS refers_to
FROM r
"""

ORACLE["op10_topk"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canonical(text: str) -> str:
    """SQL for the canonical lines of a text."""
    plain = (rf"regexp_replace(regexp_replace(lower(coalesce({text}, '')), "
             rf"'(?m){COPYRIGHT_LINE}', '', 'g'), '[^\p{{L}}\p{{N}}\n]+', ' ', 'g')")
    for a, b in EQUIVALENT_SPELLINGS:
        plain = f"replace({plain}, {_quoted(a)}, {_quoted(b)})"
    return f"list_transform(string_split({plain}, chr(10)), lambda x: trim(x, ' '))"


ORACLE["op3_licenses"] = f"""
WITH l(license, text) AS (VALUES {", ".join(f"({_quoted(a)}, {_quoted(b)})" for a, b in LICENSE_TEXTS)}),
k AS (SELECT array_to_string(list_filter({_canonical("text")}, lambda x: x <> ''), ' ') AS c, min(license) AS license FROM l GROUP BY 1),
d AS (SELECT row_number() OVER () AS r, doc_id, {_canonical("text")} AS lines FROM documents),
w AS (SELECT r, doc_id, array_to_string(list_filter(lines, lambda x: x <> ''), ' ') AS c FROM d),
n AS (SELECT r, string_agg(DISTINCT license, ',' ORDER BY license) AS notices, count(*) AS n_notices
  FROM (SELECT r, unnest(lines) AS c FROM d) JOIN k USING (c) WHERE c <> '' GROUP BY r)
SELECT doc_id, CASE WHEN w.c <> '' THEN k.license END AS license, coalesce(notices, '') AS notices,
  coalesce(n_notices, 0)::BIGINT AS n_notices
FROM w LEFT JOIN k USING (c) LEFT JOIN n USING (r)
"""


def _crc32(data: str) -> str:
    """SQL for the CRC-32 of a text's UTF-8 bytes; needs the row ``crc(t)`` of the 256 table entries."""
    octet = "('0x' || substr(hex(encode(s)), 2 * i + 1, 2))::BIGINT"
    octets = f"list_transform(range(octet_length(encode(s))), lambda i: {octet})"
    step = "xor(a >> 8, t[(xor(a, b) & 255) + 1])"
    return f"xor(list_reduce({octets}, lambda a, b: {step}, 4294967295::BIGINT), 4294967295::BIGINT)".replace("(s)", f"({data})")


_CRC_TABLE = "crc AS (SELECT list(v ORDER BY n) AS t FROM (SELECT n, list_reduce(range(8), " \
    "lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END, n) AS v FROM range(256) AS r(n)))"


def _leaf(n_chars: str = "n_chars") -> str:
    def value(c):
        return f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR END"

    return "sha256(" + " || ".join(map(value, ["doc_id", "source", "lang", n_chars, "text"])) + ")"


ORACLE["op11_merkle"] = f"""
WITH RECURSIVE {_CRC_TABLE},
d AS (
  SELECT doc_id, CASE WHEN lang IS NULL THEN '' ELSE '+' || lang END AS k, {_leaf()} AS leaf,
    CASE WHEN n_chars IS NOT NULL AND {_crc32("doc_id::VARCHAR")} % 7 = 0 THEN {_leaf("(n_chars + 1)")} END AS changed
  FROM documents, crc),
l AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY k) AS n FROM d),
tree AS (
  SELECT k, 0 AS lvl, i, n, leaf AS h FROM l
  UNION ALL
  SELECT k, any_value(lvl) + 1, i // 2, any_value((n + 1) // 2), sha256(string_agg(h, '' ORDER BY i)) FROM tree WHERE n > 1 GROUP BY k, i // 2),
sub AS (SELECT k, h AS subroot, row_number() OVER (ORDER BY k) - 1 AS i, count(*) OVER () AS n FROM tree WHERE n = 1),
top AS (
  SELECT 0 AS lvl, i, n, subroot AS h FROM sub
  UNION ALL
  SELECT any_value(lvl) + 1, i // 2, any_value((n + 1) // 2), sha256(string_agg(h, '' ORDER BY i)) FROM top WHERE n > 1 GROUP BY i // 2),
steps AS (
  SELECT k, i, n, 0 AS lvl, i AS at, n AS w, NULL::VARCHAR AS before, NULL::VARCHAR AS after FROM l
  UNION ALL
  SELECT s.k, s.i, s.n, s.lvl + 1, s.at // 2, (s.w + 1) // 2, CASE WHEN o.i < s.at THEN o.h END, CASE WHEN o.i > s.at THEN o.h END
  FROM steps s LEFT JOIN tree o ON o.k = s.k AND o.lvl = s.lvl AND o.i = xor(s.at, 1) WHERE s.w > 1),
topsteps AS (
  SELECT k, i, n, 0 AS lvl, i AS at, n AS w, NULL::VARCHAR AS before, NULL::VARCHAR AS after FROM sub
  UNION ALL
  SELECT s.k, s.i, s.n, s.lvl + 1, s.at // 2, (s.w + 1) // 2, CASE WHEN o.i < s.at THEN o.h END, CASE WHEN o.i > s.at THEN o.h END
  FROM topsteps s LEFT JOIN top o ON o.lvl = s.lvl AND o.i = xor(s.at, 1) WHERE s.w > 1),
walk AS (
  SELECT k, i, list({{'b': coalesce(before, ''), 'a': coalesce(after, '')}} ORDER BY lvl) FILTER (lvl > 0) AS p FROM steps GROUP BY k, i),
topwalk AS (
  SELECT k, list({{'b': coalesce(before, ''), 'a': coalesce(after, '')}} ORDER BY lvl) FILTER (lvl > 0) AS p FROM topsteps GROUP BY k),
f AS (
  SELECT l.doc_id, l.leaf, sub.subroot, (SELECT h FROM top WHERE n = 1) AS root,
    coalesce(walk.p, []) || coalesce(topwalk.p, []) AS p, coalesce(l.changed, l.leaf) AS start
  FROM l JOIN walk USING (k, i) JOIN topwalk USING (k) JOIN sub USING (k)),
g AS (
  SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(p, lambda x: x.b || x.a), '')) AS proof_sha256,
    list_reduce(list_transform(p, lambda x: [x.b, x.a]), lambda h, x: [sha256(x[1] || h[1] || x[2])], [start])[1] AS folded_root FROM f)
SELECT *, folded_root = root AS verified FROM g
"""


ORACLE["op12_spelling"] = f"""
WITH RECURSIVE {_CRC_TABLE},
runs AS (
  SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')) AS r FROM documents)),
docs AS (SELECT doc_id, w, count(*) AS n FROM runs GROUP BY doc_id, w),
hashed AS (SELECT w, n, {_crc32("(doc_id::VARCHAR || ':' || w)")} AS h FROM docs, crc),
made AS (SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS w, n FROM hashed),
words AS (SELECT w, sum(n)::BIGINT AS n FROM made GROUP BY w HAVING length(w) >= 7 AND sum(n) >= 2),
gaps AS (SELECT w, i, substr(w, 1, i) || substr(w, i + 2) AS v FROM words, range(64) AS r(i) WHERE i < length(w)),
pairs AS (
  SELECT a.w, b.w AS near FROM gaps a JOIN gaps b ON a.v = b.v AND a.i = b.i AND a.w <> b.w
  UNION SELECT g.w, s.w FROM gaps g JOIN words s ON s.w = g.v
  UNION SELECT s.w, g.w FROM gaps g JOIN words s ON s.w = g.v),
best AS (
  SELECT p.w, count(*) AS n_near, min(-x.n) AS less, min({{'less': -x.n, 'near': p.near}}).near AS near
  FROM pairs p JOIN words x ON x.w = p.near GROUP BY p.w),
forms AS (
  SELECT words.w, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN -less >= 10 * n THEN near END AS form,
    CASE WHEN -less >= 10 * n THEN -less END::BIGINT AS form_n
  FROM words LEFT JOIN best ON best.w = words.w),
paths AS (
  SELECT w, form AS at FROM forms WHERE form IS NOT NULL
  UNION ALL SELECT p.w, f.form FROM paths p JOIN forms f ON f.w = p.at WHERE f.form IS NOT NULL),
roots AS (SELECT p.w, p.at FROM paths p JOIN forms f ON f.w = p.at WHERE f.form IS NULL)
SELECT forms.w AS word, form, coalesce(roots.at, forms.w) AS root, n, n_near, form_n FROM forms LEFT JOIN roots ON roots.w = forms.w
"""
