"""The queries in SQL for DuckDB, written from the rules."""

from __future__ import annotations

from ..functions import lexicon as L
from . import queries as Q


def _values(rows: list[tuple], columns: str, long: str = "") -> str:
    """long: the columns that are BIGINT."""

    def literal(x: object) -> str:
        if x is None:
            return "NULL"
        return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)

    casts = ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in long.split())
    return f"SELECT *{f' REPLACE ({casts})' if casts else ''} FROM (VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) AS t({columns})"


_NORM = r"trim(regexp_replace(replace(lower({0}), ':', ' '), '[\s\x{{00A0}}]+', ' ', 'g'))"
_LINES = r"""
lines AS (SELECT doc_id, CAST(unnest(range(len(l))) AS INTEGER) AS index, trim(unnest(l), E' \t\r\n\f\x0b') AS text
          FROM (SELECT doc_id, string_split(text, E'\n') AS l FROM documents))"""
_WORDS = r"CAST(len(regexp_extract_all({0}, '\S+')) AS INTEGER)"

_TAGS = "p|h1|h2|h3|h4|h5|h6|li|dt|dd|blockquote|pre|table|div|section|article|main|nav|ul|ol|dl|footer|header|aside|form|figure"
_BODY = r"regexp_replace(regexp_replace(html, '(?is)<!--.*?-->|<(script|style)\b.*?</(script|style)>', '', 'g'), '(?is)^.*?<body\b[^>]*>', '')"
for _t in ("nav", "ul", "ol", "dl", "footer", "header", "aside", "form", "figure"):
    _BODY = rf"regexp_replace({_BODY}, '(?is)<{_t}\b.*?</{_t}>', '<{_t}></{_t}>', 'g')"
_CLEAN = r"regexp_replace({0}, '(?s)<[^>]*>', ' ', 'g')"
_INNER = "trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(" + _CLEAN + r", '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&apos;', ''''), '&amp;', '&'), '\s+', ' ', 'g'))"
_INNER = _INNER.replace('\\"', '"')
_BOOKS = rf"""
cut AS (SELECT page_id, [x FOR x IN string_split(regexp_replace({_BODY}, '(?i)<(/?)({_TAGS})\b', chr(1) || '<\1\2', 'g'), chr(1)) IF regexp_matches(x, '^<[a-zA-Z]')] AS p FROM pages),
pieces AS (SELECT page_id, i, p[i] AS html, lower(regexp_extract(p[i], '^<([a-zA-Z0-9]+)', 1)) AS tag, lower(regexp_extract(p[i + 1], '^<([a-zA-Z0-9]+)', 1)) AS next
           FROM (SELECT page_id, p, unnest(range(1, len(p) + 1)) AS i FROM cut)),
shown AS (SELECT *, {_INNER.format("html")} AS inside FROM pieces),
kept AS (SELECT * FROM shown WHERE NOT (tag IN ('div', 'section', 'article', 'main') AND inside = '' AND next IS NOT NULL
         AND next NOT IN ('nav', 'ul', 'ol', 'dl', 'footer', 'header', 'aside', 'form', 'figure'))),
placed AS (SELECT page_id // 10 AS doc_id, CAST(row_number() OVER (PARTITION BY page_id // 10 ORDER BY page_id, i) - 1 AS INTEGER) AS index, tag, html,
           tag IN ('p', 'h1', 'h2', 'h3', 'h4', 'h5', 'h6', 'li', 'dt', 'dd', 'blockquote', 'pre') AS is_paragraph, inside,
           row_number() OVER (PARTITION BY page_id ORDER BY i) = 1 AS starts_spine FROM kept),
texts AS (SELECT *, CASE WHEN is_paragraph OR tag = 'table' THEN inside ELSE '' END AS text FROM placed),
counted AS (SELECT *, {_WORDS.format("text")} AS word_count FROM texts),
book AS (SELECT doc_id, index, tag, is_paragraph, text, word_count, CASE WHEN regexp_matches(tag, '^h[1-6]$') THEN CAST(tag[2] AS INTEGER) - 1 END AS style_level,
         regexp_matches(html, '(?i)<(b|strong)\b') AS bold, starts_spine,
         is_paragraph AND text <> '' AND word_count <= 12 AND coalesce(lag(text = '') OVER w, false)
         AND coalesce(bool_or(is_paragraph AND word_count > 16) OVER (PARTITION BY doc_id ORDER BY index ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), false) AS is_isolated
         FROM counted WINDOW w AS (PARTITION BY doc_id ORDER BY index))"""

_NUMBER_WORDS = ", ".join(f"'{w}'" for w in sorted({*L.ORDINAL_WORDS, *L.CARDINAL_WORDS, *L.german_ordinals()}) if not set(w) <= set("ivxlcdm"))
_LEADS = rf"(regexp_replace(lower(strip_accents(split_part(text, ' ', 1))), '^[.:);,\-–—]+|[.:);,\-–—]+$', '', 'g') IN ({_NUMBER_WORDS}) OR regexp_matches(lower(split_part(text, ' ', 1)), '^([ivxlcdm]+|\p{{L}})[.)\]:]$'))"
_SCORED = rf"""{_BOOKS},
gate AS (SELECT *, {_LEADS} AS leads FROM book WHERE is_paragraph AND text <> '' AND (tag = 'h1' OR (word_count <= 2 AND {_LEADS}))),
run AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY index) AS run FROM (SELECT *, CASE WHEN index - lag(index) OVER (PARTITION BY doc_id ORDER BY index) > 2 THEN 1 ELSE 0 END AS new FROM gate)),
merged AS (SELECT doc_id, min(index) AS index, string_agg(text, ' ' ORDER BY index) AS text, min(style_level) AS style_level, bool_or(bold) AS bold, arg_min(starts_spine, index) AS starts_spine, arg_min(is_isolated, index) AS is_isolated FROM run GROUP BY doc_id, run),
heads AS (SELECT *, CASE WHEN style_level = 0 THEN CAST(0.9 AS DOUBLE) ELSE 0 END AS authority, CASE WHEN word_count <= 2 AND {_LEADS} THEN CAST(0.6 AS DOUBLE) * 0.88 ELSE 0 END AS lexical,
          greatest(CASE WHEN bold THEN CAST(0.28 AS DOUBLE) ELSE 0 END, CASE WHEN word_count <= 12 AND NOT regexp_matches(text, '[.?!]$') THEN 0.1 ELSE 0 END,
                   CASE WHEN regexp_matches(text, '\p{{L}}') AND NOT regexp_matches(regexp_replace(text, '\p{{Lu}}', '', 'g'), '\p{{L}}') THEN 0.7 * 0.3 ELSE 0 END) AS typographic,
          greatest(CASE WHEN starts_spine THEN CAST(0.8 AS DOUBLE) * 0.48 ELSE 0 END, CASE WHEN is_isolated THEN 0.6 * 0.4 ELSE 0 END) AS layout
          FROM (SELECT *, {_WORDS.format("text")} AS word_count FROM merged)),
scored AS (SELECT doc_id, index, text AS title, CASE WHEN style_level = 0 THEN 'chapter' ELSE 'section' END AS level,
           round((1 - (1 - authority) * (1 - lexical) * (1 - typographic) * (1 - layout)) * CASE WHEN word_count > 8 AND regexp_matches(text, '[.?!।॥]$') THEN CAST(0.4 AS DOUBLE) ELSE 1 END
                 * CASE WHEN word_count > 16 THEN 0.3 ELSE 1 END, 3) AS confidence FROM heads)"""

_RANGES = rf"""{_BOOKS},
n AS (SELECT doc_id, count(*) AS n FROM book GROUP BY doc_id),
h AS (SELECT doc_id, index, text AS title, lead(index) OVER (PARTITION BY doc_id ORDER BY index) AS nxt, row_number() OVER (PARTITION BY doc_id ORDER BY index) AS k FROM book WHERE tag = 'h1'),
r AS (SELECT doc_id, title, index AS first, CAST(coalesce(nxt, n) AS INTEGER) AS last, 'chapter' AS level FROM h JOIN n USING (doc_id)
      UNION ALL SELECT doc_id, 'Front Matter', 0, index, 'front' FROM h WHERE k = 1 AND index > 0),
chapters AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY first) - 1 AS INTEGER) AS ordinal FROM r)"""

# Titles of the pages are no labels: their one level is the chapter's, without numbers.
_CHAPTERS = rf"""{_SCORED},
c0 AS (SELECT *, {_NORM.format("title")} AS norm FROM scored WHERE confidence > 0),
c1 AS (SELECT * FROM c0 QUALIFY norm = '' OR count(*) OVER (PARTITION BY doc_id, norm) < 4),
c2 AS (SELECT * FROM c1 WHERE level = 'chapter' QUALIFY count(*) OVER (PARTITION BY doc_id) >= 2),
r AS (SELECT doc_id, index, confidence AS s, row_number() OVER w AS k, lead(confidence) OVER w AS nxt FROM c2 WINDOW w AS (PARTITION BY doc_id ORDER BY confidence DESC, index)),
top AS (SELECT doc_id, s AS hi, nxt AS lo FROM r WHERE nxt IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY s - nxt DESC, k) = 1),
t AS (SELECT doc_id, max(s) AS mx, min(s) AS mn, quantile_cont(s, 0.75) AS q3 FROM r GROUP BY doc_id),
u AS (SELECT *, (hi - lo) / (mx - mn + 1e-9) AS sep FROM t JOIN top USING (doc_id)),
v AS (SELECT *, CASE WHEN sep >= 0.08 THEN (hi + lo) / 2 ELSE q3 END AS cut FROM u),
q AS (SELECT doc_id, count(*) FILTER (WHERE s >= cut) AS passed FROM r JOIN v USING (doc_id) GROUP BY doc_id),
thr AS (SELECT doc_id, sep, round(CASE WHEN passed < 2 AND mn >= 0.4 THEN mn - 0.001 ELSE cut END, 4) AS accept FROM v JOIN q USING (doc_id)),
g0 AS (SELECT c2.*, sep FROM c2 JOIN thr USING (doc_id) WHERE confidence >= accept),
g1 AS (SELECT * FROM g0 QUALIFY row_number() OVER (PARTITION BY doc_id, norm ORDER BY index) = 1),
e AS (SELECT doc_id, index, confidence AS s, row_number() OVER (PARTITION BY doc_id ORDER BY index) AS k FROM g1),
m AS (SELECT doc_id, greatest(2, CAST(floor(0.12 * median(gap)) AS INTEGER)) AS m FROM (SELECT doc_id, lead(index) OVER (PARTITION BY doc_id ORDER BY index) - index AS gap FROM e) GROUP BY doc_id),
f AS (SELECT e.doc_id, k, [index] AS kept, s AS last FROM e WHERE k = 1
      UNION ALL
      SELECT f.doc_id, e.k, CASE WHEN e.index - f.kept[-1] >= m THEN list_append(f.kept, e.index) WHEN e.s > f.last THEN list_append(f.kept[1:len(f.kept) - 1], e.index) ELSE f.kept END,
             CASE WHEN e.index - f.kept[-1] >= m OR e.s > f.last THEN e.s ELSE f.last END
      FROM f JOIN m USING (doc_id) JOIN e ON e.doc_id = f.doc_id AND e.k = f.k + 1),
kept_ AS (SELECT doc_id, unnest(arg_max(kept, k)) AS index FROM f GROUP BY doc_id),
d AS (SELECT doc_id, index, row_number() OVER w AS k, lead(index) OVER w - index AS gap FROM kept_ WINDOW w AS (PARTITION BY doc_id ORDER BY index)),
tiny AS (SELECT doc_id, coalesce(avg(CASE WHEN gap < 3 THEN 1.0 WHEN gap IS NOT NULL THEN 0.0 END), 0) > 0.5 AS over FROM d GROUP BY doc_id),
o AS (SELECT d.doc_id, k, index AS last, index FROM d JOIN tiny USING (doc_id) WHERE k = 1 AND over
      UNION ALL
      SELECT d.doc_id, d.k, CASE WHEN d.index - o.last >= 3 THEN d.index ELSE o.last END, CASE WHEN d.index - o.last >= 3 THEN d.index END FROM o JOIN d ON d.doc_id = o.doc_id AND d.k = o.k + 1),
b0 AS (SELECT doc_id, index FROM o WHERE index IS NOT NULL UNION ALL SELECT doc_id, index FROM d JOIN tiny USING (doc_id) WHERE NOT over),
b1 AS (SELECT g0.*, count(*) OVER (PARTITION BY doc_id) AS n FROM g0 SEMI JOIN b0 USING (doc_id, index)),
b2 AS (SELECT * FROM b1 WHERE n >= 3 OR (n >= 2 AND sep >= 0.08)),
total AS (SELECT doc_id, CAST(count(*) AS INTEGER) AS n FROM book GROUP BY doc_id),
h AS (SELECT b2.doc_id, title, index, confidence, lead(index, 1, total.n) OVER (PARTITION BY b2.doc_id ORDER BY index) AS last, row_number() OVER (PARTITION BY b2.doc_id ORDER BY index) AS k FROM b2 JOIN total USING (doc_id)),
all_ AS (SELECT doc_id, title, index AS first, last, 'chapter' AS level, confidence FROM h
         UNION ALL SELECT doc_id, 'Front Matter', 0, index, 'front', 1.0 FROM h WHERE k = 1 AND index > 0
         UNION ALL SELECT doc_id, '(whole document)', 0, n, 'chapter', 0.0 FROM total ANTI JOIN b2 USING (doc_id))"""

ORACLE: dict[str, str] = {
    "seg_text_blocks": rf"""WITH {_LINES}
SELECT doc_id, index, {_WORDS.format("text")} AS word_count, text = '' AS is_empty,
       regexp_matches(text, '\p{{L}}') AND NOT regexp_matches(regexp_replace(text, '\p{{Lu}}', '', 'g'), '\p{{L}}') AS caps, {_NORM.format("text")} AS norm FROM lines""",
    "seg_html_blocks": rf"WITH {_BOOKS} SELECT * FROM book",
    "seg_numbers": _values(Q.NUMBERS, "token, system, value", "value"),
    "seg_divisions": _values(Q.DIVISIONS, "line, type, number, system, role", "number"),
    "seg_modal_sizes": """
WITH n AS (SELECT p_brand, p_size, count(*) AS n, min(p_partkey) AS first FROM part GROUP BY ALL),
b AS (SELECT p_brand, p_size AS body_size FROM n QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, first) = 1),
h AS (SELECT p_brand, p_size AS s FROM n JOIN b USING (p_brand) WHERE p_size > 1.25 * body_size AND p_size <= 2.4 * body_size
      QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, first) = 1)
SELECT p_brand, body_size, s - 1 AS band_low, s + 2 AS band_high FROM b LEFT JOIN h USING (p_brand)""",
    "seg_runs": """
WITH g AS (SELECT *, CASE WHEN event_id - lag(event_id) OVER w > 2 THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id)),
r AS (SELECT *, CAST(sum(new) OVER (PARTITION BY event_type ORDER BY event_id) AS BIGINT) AS run FROM g)
SELECT event_type, run, min(event_id) AS first, count(*) AS members, max(value) AS strongest FROM r GROUP BY event_type, run""",
    "seg_threshold": """
WITH s AS (SELECT user_id, event_id, round(value, 3) AS s FROM events),
r AS (SELECT *, row_number() OVER w AS k, lead(s) OVER w AS nxt FROM s WINDOW w AS (PARTITION BY user_id ORDER BY s DESC, event_id)),
top AS (SELECT user_id, s AS hi, nxt AS lo FROM r WHERE nxt IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY s - nxt DESC, k) = 1),
t AS (SELECT user_id, count(*) AS n, max(s) AS mx, min(s) AS mn, quantile_cont(s, 0.75) AS q3 FROM s GROUP BY user_id),
u AS (SELECT *, CASE WHEN n = 1 THEN 1.0 ELSE (hi - lo) / (mx - mn + 1e-9) END AS sep FROM t LEFT JOIN top USING (user_id)),
v AS (SELECT *, CASE WHEN n = 1 THEN mx WHEN sep >= 0.08 THEN (hi + lo) / 2 ELSE q3 END AS cut FROM u),
p AS (SELECT user_id, count(*) FILTER (WHERE s >= cut) AS passed FROM s JOIN v USING (user_id) GROUP BY user_id),
a AS (SELECT *, n > 1 AND passed < 2 AND mn >= 0.4 AS uni, CASE WHEN n > 1 AND passed < 2 AND mn >= 0.4 THEN mn - 0.001 ELSE cut END AS acc FROM v JOIN p USING (user_id)),
b AS (SELECT user_id, (s + nxt) / 2 AS mid FROM r JOIN a USING (user_id) WHERE nxt < acc QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY s - nxt DESC, k) = 1)
SELECT user_id, n, CASE WHEN n = 1 THEN acc ELSE round(acc, 4) END AS accept,
       CASE WHEN n = 1 THEN acc ELSE round(least(coalesce(mid, acc * 0.7), acc), 4) END AS review,
       CASE WHEN n = 1 THEN 'single' ELSE CASE WHEN sep >= 0.08 THEN 'gap_analysis' ELSE 'iqr_fallback' END || CASE WHEN uni THEN '+uniform_cluster' ELSE '' END END AS method,
       round(sep, 4) AS separation
FROM a LEFT JOIN b USING (user_id)""",
    "seg_min_distance": """
WITH RECURSIVE e AS (SELECT user_id AS doc_id, CAST(event_id AS INTEGER) AS index, value AS s, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
g AS (SELECT doc_id, greatest(2, CAST(floor(0.12 * median(gap)) AS INTEGER)) AS m FROM (SELECT doc_id, lead(index) OVER (PARTITION BY doc_id ORDER BY index) - index AS gap FROM e) GROUP BY doc_id),
f AS (SELECT e.doc_id, k, [index] AS kept, s AS last FROM e WHERE k = 1
      UNION ALL
      SELECT f.doc_id, e.k, CASE WHEN e.index - f.kept[-1] >= m THEN list_append(f.kept, e.index) WHEN e.s > f.last THEN list_append(f.kept[1:len(f.kept) - 1], e.index) ELSE f.kept END,
             CASE WHEN e.index - f.kept[-1] >= m OR e.s > f.last THEN e.s ELSE f.last END
      FROM f JOIN g USING (doc_id) JOIN e ON e.doc_id = f.doc_id AND e.k = f.k + 1)
SELECT doc_id, unnest(arg_max(kept, k)) AS index FROM f GROUP BY doc_id""",
    "seg_oversplit": """
WITH RECURSIVE e AS (SELECT DISTINCT user_id AS doc_id, CAST(event_id // 40 AS INTEGER) AS index FROM events),
d AS (SELECT *, row_number() OVER w AS k, lead(index) OVER w - index AS gap FROM e WINDOW w AS (PARTITION BY doc_id ORDER BY index)),
t AS (SELECT doc_id, coalesce(avg(CASE WHEN gap < 3 THEN 1.0 WHEN gap IS NOT NULL THEN 0.0 END), 0) > 0.5 AS over FROM d GROUP BY doc_id),
f AS (SELECT d.doc_id, k, index AS last, index FROM d JOIN t USING (doc_id) WHERE k = 1 AND over
      UNION ALL
      SELECT d.doc_id, d.k, CASE WHEN d.index - f.last >= 3 THEN d.index ELSE f.last END, CASE WHEN d.index - f.last >= 3 THEN d.index END FROM f JOIN d ON d.doc_id = f.doc_id AND d.k = f.k + 1)
SELECT doc_id, index FROM f WHERE index IS NOT NULL UNION ALL SELECT doc_id, index FROM d JOIN t USING (doc_id) WHERE NOT over""",
    "seg_repeated_headers": rf"WITH {_LINES}, x AS (SELECT doc_id, index, {_NORM.format('text')} AS norm FROM lines) SELECT doc_id, index FROM x QUALIFY norm = '' OR count(*) OVER (PARTITION BY doc_id, norm) < 4",
    "seg_duplicates": rf"WITH {_LINES}, x AS (SELECT doc_id, index, {_NORM.format('text')} AS norm FROM lines) SELECT doc_id, index FROM x QUALIFY index % 5 = 0 OR row_number() OVER (PARTITION BY doc_id, norm, index % 5 = 0 ORDER BY index) = 1",
    "seg_progression": """
WITH x AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN turn WHEN length(text) % 3 = 0 THEN 1 END AS number FROM conversations),
y AS (SELECT conv_id, number, lag(number) OVER (PARTITION BY conv_id ORDER BY turn) AS last FROM x WHERE number IS NOT NULL)
SELECT conv_id, round(coalesce(avg(CASE WHEN last IS NOT NULL THEN CASE WHEN number = last + 1 OR number = 1 THEN 1.0 ELSE 0.0 END END), 0.5), 3) AS progression FROM y GROUP BY conv_id""",
    "seg_regularity": """
WITH x AS (SELECT user_id AS doc_id, event_type, lead(event_id) OVER (PARTITION BY user_id, event_type ORDER BY event_id) - event_id AS gap FROM events)
SELECT doc_id, event_type, count(*) AS n, round(CASE WHEN count(*) < 3 THEN 0.5 WHEN avg(gap) = 0 THEN 0.0 ELSE 1 / (1 + stddev_pop(gap) / avg(gap)) END, 6) AS regularity FROM x GROUP BY doc_id, event_type""",
    "seg_increasing": """
WITH RECURSIVE q AS (SELECT l_orderkey, l_linenumber AS k, CAST(max(l_quantity) AS INTEGER) AS n FROM lineitem GROUP BY ALL),
p AS (SELECT l_orderkey, k, n, 1 AS size FROM q UNION SELECT q.l_orderkey, q.k, q.n, p.size + 1 FROM p JOIN q ON q.l_orderkey = p.l_orderkey AND q.k > p.k AND q.n > p.n)
SELECT l_orderkey, CAST(max(size) AS BIGINT) AS longest FROM p GROUP BY l_orderkey""",
    "seg_scores": f"WITH {_SCORED} SELECT doc_id, index, title, level, confidence FROM scored",
    "seg_triage": f"""WITH {_SCORED},
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY index) AS INTEGER) AS ordinal, count(*) OVER (PARTITION BY doc_id) AS total, count(*) FILTER (WHERE confidence < 0.5) OVER (PARTITION BY doc_id) AS weak FROM scored)
SELECT doc_id, ordinal, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY confidence, ordinal) AS INTEGER) AS weakness, weak, total FROM o WHERE confidence < 0.5""",
    "seg_ranges": f"WITH {_RANGES} SELECT doc_id, ordinal, title, first, last, level FROM chapters",
    "seg_roles": rf"""WITH {_RANGES},
x AS (SELECT *, trim(regexp_replace(lower(title), '\s+', ' ', 'g')) AS t FROM chapters),
own AS (SELECT doc_id, trim(regexp_replace(lower(arg_min(text, index)), '\s+', ' ', 'g')) AS book FROM book WHERE tag = 'h1' GROUP BY doc_id),
y AS (SELECT x.*, book, CASE WHEN level = 'front' THEN 'front_matter' WHEN regexp_matches(t, 'gutenberg|license|licence|copyright|colophon|transcriber|errata|end of the project') THEN 'back_matter' END AS fixed FROM x JOIN own USING (doc_id)),
z AS (SELECT *, coalesce(bool_or(fixed IS NULL AND t <> book) OVER (PARTITION BY doc_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS seen FROM y)
SELECT doc_id, ordinal, CASE WHEN fixed IS NOT NULL THEN fixed WHEN book <> '' AND t = book AND NOT seen THEN 'front_matter' ELSE 'body' END AS role FROM z""",
    "seg_containing": f"""WITH {_RANGES}
SELECT b.doc_id, ordinal, CAST(sum(word_count) AS BIGINT) AS words, count(*) AS blocks FROM book b JOIN chapters c ON b.doc_id = c.doc_id AND b.index >= c.first AND b.index < c.last GROUP BY b.doc_id, ordinal""",
    "seg_names": rf"""WITH {_LINES},
t AS (SELECT doc_id, index, text AS title FROM lines),
s AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(title, '[\x00-\x1f]', '', 'g'), '[<>:"/\\|?*]', '_', 'g'), '[\s_]+', '_', 'g'), '^[_.]+|[_.]+$', '', 'g')[1:60] AS stem FROM t),
u AS (SELECT *, CASE WHEN regexp_replace(stem, '[_.]+$', '') = '' THEN 'untitled' ELSE regexp_replace(stem, '[_.]+$', '') END AS final,
      regexp_replace(title, '[^\p{{L}}\p{{N}}_\s\-]', '', 'g') AS plain FROM s),
v AS (SELECT *, regexp_replace(lower(trim(plain)), '\s+', '_', 'g')[1:48] AS sl, regexp_replace(regexp_replace(lower(plain), '[\s_\-]+', '_', 'g'), '^_+|_+$', '', 'g')[1:60] AS ws FROM u)
SELECT doc_id, index, final AS stem, CASE WHEN length(CAST(doc_id AS VARCHAR)) < 2 THEN '0' ELSE '' END || doc_id || '_' || CASE WHEN title = '' THEN 'chapter_' || doc_id ELSE final END || '.docx' AS file,
       CASE WHEN sl = '' THEN 'chapter' ELSE sl END AS slug, CASE WHEN ws = '' THEN 'chapter' ELSE ws END AS web_slug,
       trim(regexp_replace(regexp_replace(lower(regexp_replace(title, '[\s.\x{{2026}}]+\d{{1,4}}\s*$', '')), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g')) AS entry FROM v""",
    "seg_hrefs": _values(Q.HREFS, "base, ref, path"),
    "seg_members": _values(Q.MEMBERS, "member, safe"),
    "seg_numbering_prune": _values([(1, 38, 1), (1, 101, 2), (1, 191, 3), (1, 251, 4)], "doc_id, index, number", "doc_id number"),
    "seg_list_starts": _values([(1, 10), (1, 40), (1, 80), (2, 60), (2, 90)], "doc_id, index", "doc_id"),
    "seg_toc_field": _values([(1, 10, "Preface", 0), (1, 20, "The Old Mill", 1), (1, 30, "The River at Nigth", 1), (1, 40, "Homecoming", 1)], "doc_id, index, title, level", "doc_id"),
    "seg_chapters": rf"""WITH RECURSIVE {_CHAPTERS}
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY first) - 1 AS INTEGER) AS ordinal, title, CAST(first AS INTEGER) AS first, CAST(last AS INTEGER) AS last, level, CAST(confidence AS DOUBLE) AS confidence,
       CASE WHEN level = 'front' THEN 'front_matter' WHEN title <> '(whole document)' AND regexp_matches(lower(title), 'gutenberg|license|licence|copyright|colophon|transcriber|errata|end of the project') THEN 'back_matter' ELSE 'body' END AS role FROM all_""",
    "seg_plans": rf"""WITH RECURSIVE {_CHAPTERS},
how AS (SELECT doc_id, round(sep, 4) AS separation, accept, CASE WHEN sep >= 0.08 THEN 'gap_analysis' ELSE 'iqr_fallback' END || CASE WHEN passed < 2 AND mn >= 0.4 THEN '+uniform_cluster' ELSE '' END AS method
        FROM thr JOIN (SELECT doc_id, mn, passed FROM v JOIN q USING (doc_id)) USING (doc_id)),
left_ AS (SELECT doc_id, count(*) AS k FROM b1 GROUP BY doc_id),
x AS (SELECT total.doc_id, total.n AS n_blocks, how.*, coalesce(k, 0) AS k, how.doc_id IS NULL AS none, coalesce(separation, 0) < 0.08 AS loose FROM total LEFT JOIN how ON how.doc_id = total.doc_id LEFT JOIN left_ ON left_.doc_id = total.doc_id)
SELECT doc_id, n_blocks, 11 AS body_size, k < 2 OR (loose AND k < 3) AS abstained,
       CASE WHEN k < 2 OR (loose AND k < 3) THEN concat_ws('; ', CASE WHEN none THEN 'no_structure_discovered' END, CASE WHEN loose THEN 'insufficient_confidence_separation' END, CASE WHEN k < 2 THEN 'too_few_validated_boundaries' END) END AS reason,
       coalesce(method, 'empty') AS method, accept, separation, CASE WHEN NOT none THEN 'chapter' END AS split_level, CASE WHEN NOT none THEN 'Chapter' END AS hierarchy, CASE WHEN NOT none THEN '' END AS flags FROM x""",
}
