"""SQL twins of the training-data queries that SQL can express.

The others rest on trained models, hashes or binary output; the tests hold those against
brute force, an exact round trip or held-out accuracy.
"""

from __future__ import annotations

from quire.llm.licenses import PHRASES, TEMPLATES, THRESHOLD, template_words

_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UNSPACED = r"[^\x20\x09-\x0D]+"

NEAR = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_FOLD}, '{_UNSPACED}') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS sh
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - least(len(w), 5) + 1)) AS i FROM d WHERE len(w) > 0)
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (sh) GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)
),
reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
first AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(component_id, doc_id) AS component_id,
  coalesce(component_id, doc_id) = doc_id AS kept
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN first USING (doc_id)
"""

EXACT = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
),
r AS (
  SELECT doc_id, first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id) AS keep_id,
    count(*) OVER (PARTITION BY norm) AS group_size, norm
  FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM r
"""

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_FOLD}, '{_ALNUM}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_FOLD}, '{_ALNUM}') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS s
  FROM (
    SELECT item_id, w, least(len(w), 10) AS k, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) AS i
    FROM b WHERE len(w) > 0
  )
),
dw AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS s
  FROM (
    SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i
    FROM d, (SELECT DISTINCT k FROM bw) WHERE len(w) >= k
  )
),
h AS (SELECT doc_id, i, k, item_id FROM dw JOIN bw USING (k, s)),
p AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(generate_series(i, i + k - 1)) AS p FROM h) GROUP BY 1),
m AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY 1
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(p.n, 0)::BIGINT AS n_hit, coalesce(m.n, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(p.n, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN m USING (doc_id)
"""


#: The crc32 table is worked out by its polynomial; the least edits by places of the
#: pattern (0 the start, 1 after s, 2 after u, 3 after a), one turn after the other.
REPAIR = r"""
WITH RECURSIVE t AS (
  SELECT list_transform(range(256), lambda x: list_reduce([x::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END)) AS crc
),
h AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_concat([4294967295::BIGINT],
      list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ord(x)::BIGINT)),
      lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) % 20 AS fault
  FROM conversations, t
),
d AS (
  SELECT conv_id, turn, fault, k, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
    CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM h, (VALUES (1), (2)) AS copies(k) WHERE fault <> 0 AND (k = 1 OR fault = 3)
),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS i FROM d),
m AS (
  SELECT *, left(role, 1) AS x, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS shown,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS seen,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS px
  FROM o
),
f AS (
  SELECT *, CASE WHEN shown = '' THEN 'blank' WHEN seen THEN 'duplicate' WHEN right(shown, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault1
  FROM m
),
counts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault1 = 'blank') AS blank, count(*) FILTER (fault1 = 'duplicate') AS duplicate,
    count(*) FILTER (fault1 = 'truncated') AS truncated,
    count(*) FILTER (px IS NOT NULL AND px || x NOT IN ('su', 'ua', 'au')) AS illegal
  FROM f GROUP BY conv_id
),
ins(p, q, c, a) AS (
  VALUES (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''), (0, 2, 2, 'I'), (0, 3, 4, 'II'), (1, 2, 2, 'I'), (1, 3, 4, 'II'),
    (2, 3, 2, 'I'), (3, 2, 2, 'I')
),
step(p, q, x) AS (VALUES (0, 1, 's'), (0, 2, 'u'), (1, 2, 'u'), (3, 2, 'u'), (2, 3, 'a')),
edits AS (
  SELECT conv_id, i, p, p AS q, 3 AS c, 'D' AS a FROM f, (VALUES (0), (1), (2), (3)) AS places(p)
  UNION ALL
  SELECT conv_id, i, p, q, (fault1 IS NOT NULL)::INT, 'K' FROM f JOIN step USING (x) WHERE coalesce(fault1, 'truncated') = 'truncated'
  UNION ALL
  SELECT conv_id, i, p, q, 2 + (fault1 IS NOT NULL)::INT, 'R' FROM f, step WHERE step.x <> 's' AND coalesce(fault1, 'truncated') = 'truncated'
),
moves AS (
  SELECT conv_id, i, ins.p, edits.q, min({'c': ins.c + edits.c, 'a': ins.a || edits.a}) AS e
  FROM edits JOIN ins ON ins.q = edits.p GROUP BY ALL
),
least AS (
  SELECT conv_id, 0::BIGINT AS i, 0 AS q, {'c': 0, 'a': ''} AS e FROM counts
  UNION ALL
  SELECT s.conv_id, m.i, m.q, min({'c': s.e.c + m.e.c, 'a': s.e.a || m.e.a})
  FROM least s JOIN moves m ON m.conv_id IS NOT DISTINCT FROM s.conv_id AND m.i = s.i + 1 AND m.p = s.q
  GROUP BY s.conv_id, m.i, m.q
),
best AS (
  SELECT s.conv_id, min({'c': s.e.c + ins.c, 'a': s.e.a || ins.a}) AS e
  FROM least s JOIN counts ON counts.conv_id IS NOT DISTINCT FROM s.conv_id AND s.i = n JOIN ins ON ins.p = s.q AND ins.q IN (0, 3)
  GROUP BY s.conv_id
),
marks AS (
  SELECT conv_id, e.a AS a, len(replace(e.a, 'D', '')) % 2 AS s, unnest(string_split(e.a, '')) AS y, generate_subscripts(string_split(e.a, ''), 1) AS j
  FROM best WHERE e.a <> ''
),
places AS (
  SELECT *, sum((y <> 'I')::INT) OVER w AS i, sum((y <> 'D')::INT) OVER w AS place
  FROM marks WINDOW w AS (PARTITION BY conv_id ORDER BY j)
),
turns AS (
  SELECT p.conv_id, p.place,
    CASE WHEN y = 'K' THEN f.role WHEN (p.place - s) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN y = 'I' THEN '' ELSE f.text END AS line
  FROM places p LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.i AND y <> 'I'
  WHERE y <> 'D'
),
repaired AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY place) AS text FROM turns GROUP BY conv_id),
ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT ids.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(e.c, 0)::BIGINT AS cost,
  coalesce(e.a, '') AS audit, sha256(coalesce(repaired.text, '')) AS repaired_sha256
FROM ids LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM ids.conv_id
LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN repaired ON repaired.conv_id IS NOT DISTINCT FROM ids.conv_id
"""


DIVERGENCE = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
o AS (
  SELECT r, lang, source,
    unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM d
),
kept AS (SELECT lang, term FROM o GROUP BY ALL HAVING count(DISTINCT r) >= 30),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
grp AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM o JOIN kept USING (lang, term) GROUP BY ALL),
cells AS (SELECT lang, source, term, coalesce(n, 0) AS n FROM grp JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
gn AS (SELECT lang, source, sum(n) AS total FROM cells GROUP BY ALL),
p AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 5)) // (total + 5 * v) AS p FROM cells JOIN gn USING (lang, source) JOIN v USING (lang)),
ln AS (SELECT lang, sum(total) AS total FROM gn GROUP BY lang),
q AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 5)) // (any_value(total) + 5 * any_value(v)) AS q
  FROM cells JOIN ln USING (lang) JOIN v USING (lang) GROUP BY lang, term
),
pair AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(sum(abs(x.p - y.p)), 0) AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source
  LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  WHERE x.term IS NULL OR y.term IS NOT NULL
  GROUP BY ALL
),
own AS (SELECT lang, source, term AS item, p - q AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, 'pair' AS part, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pair
  UNION ALL
  SELECT *, 'term' AS part, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM own
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""


def _licenses() -> str:
    phrases = ", ".join(f"('{p}', '{label}', {len(p.split())})" for p, label in PHRASES.items())
    sets = [(label, template_words(text)) for label, text in TEMPLATES]
    templates = ", ".join(f"({k}, '{label}', {words})" for k, (label, words) in enumerate(sets))
    return f"""
WITH d AS (SELECT doc_id, {_FOLD} AS t, regexp_extract_all({_FOLD}, '{_ALNUM}') AS w FROM documents),
phrases(p, label, k) AS (VALUES {phrases}),
templates(id, label, words) AS (VALUES {templates}),
places AS (
  SELECT doc_id, label, i - 1 AS place
  FROM (SELECT doc_id, w, p, label, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM d, phrases WHERE len(w) >= k)
  WHERE array_to_string(w[i:i + k - 1], ' ') = p
),
base AS (
  SELECT doc_id, count(*) AS n, min(place) AS lo, max(place) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM places GROUP BY 1
),
blocks AS (SELECT DISTINCT doc_id, regexp_extract_all(unnest(string_split(t, chr(10))), '{_ALNUM}') AS bw FROM d),
hits AS (
  SELECT doc_id, label, max(len(list_intersect(words, bw)) / len(words)) AS c
  FROM blocks, templates WHERE len(list_intersect(words, bw)) >= {THRESHOLD} * len(words) GROUP BY ALL
),
own AS (SELECT doc_id, max(c) AS c FROM hits GROUP BY 1),
named AS (
  SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM (SELECT doc_id, label FROM hits UNION SELECT doc_id, label FROM places) GROUP BY 1
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(base.n, 0)::BIGINT AS n_base, lo::BIGINT AS first_word, hi::BIGINT AS last_word,
  coalesce(base.labels, '') AS base_labels, coalesce(named.labels, '') AS labels,
  CASE WHEN base.n > 0 THEN 1.0::DOUBLE ELSE coalesce(own.c, 0)::DOUBLE END AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN own USING (doc_id) LEFT JOIN named USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op3_near_duplicates": NEAR,
        "op4_exact_duplicates": EXACT,
        "op5_decontamination": DECONTAMINATION,
        "op8_licenses": _licenses(),
        "op12_conversation_repair": REPAIR,
        "op13_source_divergence": DIVERGENCE,
    }
