"""ANSI-style SQL twins of the text queries, for checking against another engine.

They follow the window formulation (rows of lines, lead/lag) where the Spark side works on
arrays inside the document row, so the two sides share the patterns but not the method.
"""

from __future__ import annotations

from ..functions import patterns as P

NL = "chr(10)"


def q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def q_list(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def js_trim(x: str) -> str:
    return f"trim({x}, {q(P.JS_SPACE_CHARS)})"


def py_strip(x: str) -> str:
    return f"trim({x}, {q(P.PY_SPACE_CHARS)})"


def hit(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {q(pattern)})"


def hits(x: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all({x}, {q(pattern)}, {group})"


def count(x: str, pattern: str) -> str:
    return f"len({hits(x, pattern)})"


def words(x: str) -> str:
    return count(x, f"[^{P.JS_SPACE}]+")


def without(x: str, pattern: str) -> str:
    return f"regexp_replace({x}, {q(pattern)}, '', 'g')"


def line_rows(source: str) -> str:
    return (f"SELECT doc_id, unnest(range(len(parts))) AS ln, unnest(parts) AS line "
            f"FROM (SELECT doc_id, string_split(text, {NL}) AS parts FROM {source})")


RAW_LINES = f"lines AS ({line_rows('documents')})"

LEGAL_DOCS = f"""{RAW_LINES}, legal_docs AS (
SELECT doc_id, concat(string_agg(l, chr(10) ORDER BY ln), chr(10), 'ANNEX A', chr(10), 'Definitions', chr(10),
  'DEFINITIONS AND TERMS', chr(10), 'end') AS text
FROM (SELECT doc_id, ln, CASE
  WHEN ln = 0 AND doc_id % 5 = 0 THEN concat('PREAMBLE', chr(10), 'Members,', chr(10), 'Noting ', line, chr(10), line,
    chr(10), 'Hereby agree as follows:')
  WHEN ln % 6 = 0 THEN concat('CHAPTER ', cast(cast(floor(ln / 6) AS int) + 1 AS varchar), chr(10), line)
  WHEN ln % 6 = 1 THEN concat('Article ', cast(ln AS varchar), ': Scope', chr(10), line)
  WHEN ln % 6 = 2 THEN concat('1.', chr(10), line)
  WHEN ln % 6 = 3 THEN concat('(a)', chr(10), line)
  WHEN ln % 6 = 4 AND doc_id % 2 = 0 THEN concat('6. (b) ', line)
  WHEN ln % 6 = 4 THEN concat('7. ', line)
  WHEN doc_id % 3 = 0 THEN concat(cast(ln AS varchar), ' "', line, '"')
  ELSE concat(cast(ln AS varchar), chr(10), line) END AS l FROM lines)
GROUP BY doc_id)"""

FOOTNOTE_DOCS = f"""{RAW_LINES}, footnote_docs AS (
SELECT doc_id, concat(string_agg(l, chr(10) ORDER BY ln), chr(10), string_agg(d, '' ORDER BY ln)) AS text
FROM (SELECT doc_id, ln,
  CASE WHEN ln % 2 = 0 THEN concat(line, '{{{{footnotenumber', cast(100 + ln AS varchar), '}}}}') ELSE line END AS l,
  CASE WHEN ln % 4 = 0 THEN concat('{{{{footnote', cast(100 + ln AS varchar), '}}}} ', cast(ln AS varchar),
    ' note {{{{-footnote', cast(100 + ln AS varchar), '}}}}') ELSE '' END AS d FROM lines)
GROUP BY doc_id)"""

TAGGED_DOCS = f"""{RAW_LINES}, tagged_docs AS (
SELECT doc_id, string_agg(l, chr(10) ORDER BY ln) AS text
FROM (SELECT doc_id, ln, CASE
  WHEN ln % 6 = 0 THEN concat('<h>', line, '</h>')
  WHEN ln % 6 = 2 OR ln % 6 = 3 THEN concat('<li>', line, '</li>')
  WHEN ln % 6 = 4 THEN concat('<p>', line, '<fn>[', cast(ln AS varchar), '] note ', cast(ln AS varchar), '</fn></p>')
  ELSE concat('<p>', line, '</p>') END AS l FROM lines)
GROUP BY doc_id)"""

CONVERSATION_PAGES = "pages_in AS (SELECT conv_id AS doc_id, turn + 1 AS page_no, text FROM conversations)"

# ------------------------------------------------------------------------------------------ page quality
FLAGS = {
    "short": "length(t) < 200",
    "odd_breaks": f"{count('t', P.ODD_LINE_BREAK)} > 3",
    "missing_spaces": f"{count('t', P.MISSING_SPACE)} > 5",
    "special_chars": f"{count('t', P.SPECIAL_CHAR)} > length(t) * 0.05::DOUBLE",
    "fragmented": rf"{count('t', r'\b[A-Za-z0-9_]{1,2}\b')} > ({count('t', f'[{P.JS_SPACE}]+')} + 1) * 0.3::DOUBLE",
}
QUALITY = f"""trimmed AS (SELECT *, {js_trim('text')} AS t FROM documents),
quality AS (SELECT *, {', '.join(f'{rule} AS {name}' for name, rule in FLAGS.items())} FROM trimmed WHERE t <> ''),
checked AS (SELECT *, {' OR '.join(FLAGS)} AS is_problem FROM quality)"""

PAGE_QUALITY_BY_LANG = f"""WITH {QUALITY} SELECT lang, count(*) AS pages,
{', '.join(f'count(*) FILTER (WHERE {name}) AS {name}_pages' for name in FLAGS)},
count(*) FILTER (WHERE is_problem) AS problem_pages FROM checked GROUP BY lang"""

PAGE_ISSUE_REPORT = f"""WITH {QUALITY} SELECT doc_id, 1 AS page_no, concat('Página 1: ', concat_ws(', ',
CASE WHEN short THEN {q(P.ISSUE_SHORT)} END, CASE WHEN odd_breaks THEN {q(P.ISSUE_ODD_BREAKS)} END,
CASE WHEN missing_spaces THEN {q(P.ISSUE_MISSING_SPACES)} END,
CASE WHEN special_chars THEN {q(P.ISSUE_SPECIAL_CHARS)} END,
CASE WHEN fragmented THEN {q(P.ISSUE_FRAGMENTED)} END)) AS report FROM checked WHERE is_problem"""

PAGE_FALLBACK_CRITERIA = f"""WITH {QUALITY}, judged AS (SELECT doc_id, 1 AS page_no, concat_ws(', ',
CASE WHEN length(t) < 150 THEN {q(P.FALLBACK_SHORT)} END,
CASE WHEN {count('t', f'[{P.JS_SPACE}]+')} + 1 < 20 THEN {q(P.FALLBACK_FEW_WORDS)} END,
CASE WHEN {count('t', P.ODD_LINE_BREAK)} > 2 THEN {q(P.FALLBACK_ODD_BREAKS)} END,
CASE WHEN contains(t, '□') OR contains(t, '■') THEN {q(P.FALLBACK_PLACEHOLDER)} END,
CASE WHEN {hit('left(t, 100)', r'[^\x00-\x7F]')} THEN {q(P.FALLBACK_NON_ASCII)} END) AS issues
FROM checked WHERE NOT is_problem) SELECT * FROM judged WHERE issues <> ''"""

DOCUMENT_PROBE = f"""SELECT doc_id, concat_ws(', ',
CASE WHEN length(text) < 100 THEN {q(P.PROBE_SHORT)} END,
CASE WHEN {count('text', P.SPECIAL_CHAR)} > 10 THEN concat({q(P.PROBE_SPECIAL)}, {count('text', P.SPECIAL_CHAR)}) END,
CASE WHEN {count('text', P.NUMBER_RUN)} > 5 THEN concat({q(P.PROBE_NUMBERS)}, {count('text', P.NUMBER_RUN)}) END,
CASE WHEN {count('text', P.ODD_LINE_BREAK)} > 3 THEN concat({q(P.PROBE_BREAKS)}, {count('text', P.ODD_LINE_BREAK)}) END
) AS issues, CASE WHEN length(text) > 100 THEN {q(P.SUFFICIENT)} WHEN length(text) > 0 THEN {q(P.LITTLE_TEXT)}
ELSE {q(P.NO_TEXT)} END AS sufficiency FROM documents"""

PAGE_ROUTING = f"""WITH sized AS (SELECT doc_id, text, length({js_trim('text')}) AS n FROM documents)
SELECT doc_id, 1 AS page_no, CASE WHEN n > 200 THEN 'Completed' ELSE 'Processing OCR' END AS status,
CASE WHEN n > 200 THEN 'Quick Text' END AS method, CASE WHEN n > 100 THEN 'Completed' ELSE 'Pending' END
AS enhanced_status, CASE WHEN length(text) > 50 THEN 'AI Correction' ELSE 'AI OCR' END AS correction_method FROM sized"""

PAGE_SCAN = f"""WITH {CONVERSATION_PAGES}, pieces AS (SELECT doc_id, page_no,
string_split_regex(text, {q(f'[{P.JS_SPACE}]+')}) AS items FROM pages_in)
SELECT doc_id, page_no, 'Pending' AS status, {js_trim("array_to_string(items, ' ')")} AS text FROM pieces"""

DOC_STATISTICS = f"""SELECT doc_id, len(string_split(text, {NL}))::BIGINT AS total_lines,
{words('text')}::BIGINT AS total_words, length(text)::BIGINT AS total_characters FROM documents"""

# ------------------------------------------------------------------------------------------ pages as documents
_PART = "0::BIGINT"


def consolidated(text: str, separator: str) -> str:
    return f"string_agg({text}, {separator} ORDER BY page_no)"


CONSOLIDATE_PAGES = f"""WITH {CONVERSATION_PAGES} SELECT doc_id, {_PART} AS part_no,
{consolidated('text', NL)} AS plain, {consolidated('text', f'{NL} || {NL}')} AS spaced,
{consolidated(f"CASE WHEN text = '' THEN '' ELSE concat(text, {NL}, {NL}, '--- PAGE ', page_no, ' ---', {NL}, {NL}) END",
              "''")} AS page_after,
{consolidated(f"concat('--- END OF PAGE ', page_no, ' ---', {NL}, text)", f'{NL} || {NL}')} AS page_end_before,
{consolidated(f"concat('--- PAGE ', page_no, ' ---', {NL}, text)", f'{NL} || {NL}')} AS page_before
FROM pages_in GROUP BY doc_id, {_PART}"""

PAGE_SPLIT_ROUNDTRIP = f"""WITH {CONVERSATION_PAGES}, marked AS (SELECT doc_id,
{consolidated(f"concat('--- END OF PAGE ', page_no, ' ---', {NL}, text)", f'{NL} || {NL}')} AS text
FROM pages_in GROUP BY doc_id), split AS (SELECT doc_id, string_split_regex(text, {q(P.PAGE_END_MARK)}) AS parts
FROM marked) SELECT doc_id, unnest(range(1, len(parts) + 1)) AS page_no, {js_trim('unnest(parts)')} AS text FROM split"""

PAGE_CHUNKS = f"""WITH {CONVERSATION_PAGES}, numbered AS (SELECT doc_id, page_no,
row_number() OVER (PARTITION BY doc_id ORDER BY page_no) AS item_no FROM pages_in)
SELECT doc_id, page_no, item_no, (item_no - 1) // 5 AS chunk_no, item_no % 10 = 0 AS saves_extraction,
item_no % 5 = 0 AS saves_correction FROM numbered"""

TEXT_CHUNKS = """WITH counted AS (SELECT doc_id, text, greatest(1, ceil(length(text) / 30000.0)::BIGINT) AS n
FROM documents), numbered AS (SELECT doc_id, text, unnest(range(n)) AS chunk_no FROM counted)
SELECT doc_id, chunk_no, substring(text, chunk_no * 30000 + 1, 30000) AS text FROM numbered"""

PREVIEWS_AND_SIZES = """WITH d AS (SELECT doc_id, text, source, n_chars, n_chars * 700 AS size,
len(regexp_extract_all(text, '[^' || '""" + P.JS_SPACE + """' || ']+')) AS words FROM documents)
SELECT doc_id, CASE WHEN length(text) > 100 THEN concat(left(text, 100), '...') ELSE text END AS preview_100,
CASE WHEN length(text) > 300 THEN concat(left(text, 300), '...') ELSE text END AS preview_300,
left(text, 50) AS click_text,
CASE WHEN size / 1048576 > 1 THEN concat(format('{:.2f}', floor(size / 1048576 * 100 + 0.5) / 100), ' MB')
  ELSE concat(format('{:.2f}', floor(size / 1024 * 100 + 0.5) / 100), ' KB') END AS size_text,
concat(cast(floor(floor(size / 1048576 * 10 + 0.5) / 10) AS BIGINT),
  CASE WHEN floor(size / 1048576 * 10 + 0.5)::BIGINT % 10 > 0
    THEN concat('.', floor(size / 1048576 * 10 + 0.5)::BIGINT % 10) ELSE '' END, ' MB') AS size_mb,
concat(cast(floor(words / 1000 + 0.5) AS BIGINT), 'K') AS words_text,
concat(n_chars // 60, ':', lpad((n_chars % 60)::VARCHAR, 2, '0')) AS timer_text,
size > 10485760 OR contains(lower(source), 'large') AS is_large, ceil(words / 20)::BIGINT > 50 AS is_enhanced,
ceil(words / 20)::BIGINT > 100 AS drops_images FROM d"""

REPLIES = f"""replies AS (SELECT doc_id, CASE doc_id % 3
WHEN 0 THEN concat(text, {NL}, '---CHANGES MADE---', {NL}, 'spacing fixed', {NL}, '---END CHANGES---')
WHEN 1 THEN concat(text, {NL}, '---NO CHANGES NEEDED---') ELSE text END AS reply FROM documents WHERE doc_id % 2 = 0)"""

FLAGGED = f"""flagged AS (SELECT doc_id, 1 AS page_no FROM checked WHERE is_problem
UNION SELECT doc_id, 1 FROM documents WHERE doc_id % 3 = 0)"""

PROBLEM_PAGES = f"WITH {QUALITY}, {FLAGGED} SELECT doc_id, page_no FROM flagged"

_BLOCK = r"(?s)---(CHANGES MADE|OCR ANALYSIS)---(.*?)---END (CHANGES|ANALYSIS)---"
CORRECTED = f"""{QUALITY}, {FLAGGED}, {REPLIES}, paired AS (
SELECT d.doc_id, d.text, f.doc_id IS NOT NULL AS listed, r.reply, length({js_trim('d.text')}) AS n,
  length(d.text) > 50 AS has_text
FROM documents d LEFT JOIN flagged f USING (doc_id) LEFT JOIN replies r USING (doc_id)),
corrected AS (SELECT doc_id, 1 AS page_no, CASE WHEN listed AND reply IS NOT NULL THEN 'Completed'
  WHEN listed THEN 'AI Correction' WHEN n > 200 THEN 'Completed' ELSE 'Processing OCR' END AS status,
CASE WHEN listed AND reply IS NOT NULL THEN CASE WHEN has_text THEN 'AI Correction' ELSE 'AI OCR' END
  WHEN n > 200 THEN 'Quick Text' END AS method,
CASE WHEN listed AND reply IS NOT NULL THEN CASE
  WHEN has_text THEN {js_trim(f"replace(regexp_replace(reply, {q('(?s)' + P.CHANGES_BLOCK)}, ''), {q(P.CHANGES_NONE)}, '')")}
  ELSE {js_trim(f"replace(regexp_replace(reply, {q('(?s)' + P.ANALYSIS_BLOCK)}, ''), {q(P.ANALYSIS_CLEAN)}, '')")} END
  ELSE text END AS text,
CASE WHEN listed AND reply IS NOT NULL THEN CASE WHEN NOT has_text THEN {q(P.NOTE_ANALYSIS_MISSING)}
  WHEN {hit('reply', '(?s)' + P.CHANGES_BLOCK)} THEN {js_trim(f"regexp_extract(reply, {q('(?s)' + P.CHANGES_BLOCK)}, 1)")}
  WHEN contains(reply, {q(P.CHANGES_NONE)}) THEN {q(P.NOTE_NO_CHANGES)} ELSE {q(P.NOTE_CHANGES_MISSING)} END END AS changes
FROM paired)"""
CORRECTIONS_APPLIED = f"WITH {CORRECTED} SELECT doc_id, page_no, status, method, text, changes FROM corrected"
PAGE_METHOD_COUNTS = f"""WITH {CORRECTED} SELECT count(*) AS pages_analyzed,
count(*) FILTER (WHERE method = 'AI OCR') AS ocr_pages,
count(*) FILTER (WHERE method = 'AI Correction') AS correction_pages,
count(*) FILTER (WHERE method = 'Quick Text') AS quick_text_pages,
count(*) FILTER (WHERE status = 'Error') AS error_pages,
count(*) FILTER (WHERE method IN ('AI Correction', 'AI OCR')) AS model_pages FROM corrected"""
PAGES_TO_RESUME = f"""WITH {CORRECTED}, progress AS (SELECT *, doc_id // 10 AS batch FROM corrected)
SELECT batch AS doc_id, count(*) FILTER (WHERE status <> 'Processing OCR') AS start_from,
bool_and(status <> 'Processing OCR') AS all_extracted FROM progress GROUP BY batch"""

# ------------------------------------------------------------------------------------------ outline
OPENS = f"""CASE WHEN length(l) < 3 THEN NULL WHEN {hit('l', P.MAIN_HEADING)} THEN 'heading:1'
WHEN {hit('l', P.ANNEX_HEADING)} THEN 'annex:1'
WHEN {hit('l', P.SUB_HEADING)} OR {hit('l', P.NUMBERED_HEADING)} THEN 'section:2'
WHEN {hit('l', P.ALL_CAPS_TITLE)} AND length(l) > 10 THEN 'heading:1'
WHEN {hit('l', P.DEFINITIONS_HEADING)} THEN 'section:2' END"""
CLOSES = f"""length(l) >= 3 AND ({hit('l', P.MAIN_HEADING)} OR {hit('l', P.SUB_HEADING)} OR
{hit('l', P.NUMBERED_HEADING)} OR {hit('l', P.ANNEX_HEADING)} OR {hit('l', P.ALL_CAPS_BREAK)})"""
SECTIONS = f"""{LEGAL_DOCS}, legal_lines AS ({line_rows('legal_docs')}),
judged AS (SELECT doc_id, ln + 1 AS line_no, line, {words('line')} AS words, l, {OPENS} AS kind, {CLOSES} AS closes
  FROM (SELECT *, {js_trim('line')} AS l FROM legal_lines)),
spans AS (SELECT *, sum(words) OVER (PARTITION BY doc_id ORDER BY line_no) AS running,
  coalesce(min(CASE WHEN closes THEN line_no END) OVER (PARTITION BY doc_id ORDER BY line_no
    ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) - 1, max(line_no) OVER (PARTITION BY doc_id)) AS end_line
  FROM judged),
sections AS (SELECT s.doc_id, row_number() OVER (PARTITION BY s.doc_id ORDER BY s.line_no) - 1 AS section_no,
  s.l AS title, split_part(s.kind, ':', 2)::INT AS level, split_part(s.kind, ':', 1) AS type, s.line_no AS start_line,
  s.end_line, (e.running - s.running + s.words)::BIGINT AS word_count
  FROM spans s JOIN spans e ON e.doc_id = s.doc_id AND e.line_no = s.end_line WHERE s.kind IS NOT NULL)"""

OUTLINE_SECTIONS = f"""WITH {SECTIONS} SELECT doc_id, section_no, concat('section-', section_no) AS section_id, title,
level, type, start_line, end_line, word_count FROM sections"""
OUTLINE_CONTENT = f"""WITH {SECTIONS} SELECT s.doc_id, section_no, string_agg(line, {NL} ORDER BY line_no) AS content
FROM sections s JOIN judged j ON j.doc_id = s.doc_id AND line_no BETWEEN start_line AND end_line
GROUP BY s.doc_id, section_no"""
OUTLINE_SUMMARY = f"""WITH {SECTIONS}, counts AS (SELECT doc_id, count(*) AS total_sections,
count(*) FILTER (WHERE type = 'annex') AS annexes, count(*) FILTER (WHERE type <> 'annex') AS main_sections
FROM sections GROUP BY doc_id) SELECT d.doc_id, len(string_split(text, {NL})) AS total_lines,
{words('text')} AS total_words, length(text) AS total_characters, coalesce(total_sections, 0) AS total_sections,
coalesce(annexes, 0) AS annexes, coalesce(main_sections, 0) AS main_sections
FROM legal_docs d LEFT JOIN counts c USING (doc_id)"""
OUTLINE_TOC = f"""WITH {SECTIONS} SELECT doc_id, concat('TABLE OF CONTENTS', {NL}, '==================', {NL}, {NL},
string_agg(concat(repeat('  ', level - 1), title, ' (Line ', start_line, ')', {NL}), '' ORDER BY section_no)) AS toc
FROM sections GROUP BY doc_id"""
OUTLINE_FILTER = f"""WITH {SECTIONS}, toggles AS (
SELECT doc_id, unnest([1, 2, 2, 5, 9]) AS section_no FROM documents),
chosen AS (SELECT doc_id, section_no FROM toggles GROUP BY ALL HAVING count(*) % 2 = 1),
gone AS (SELECT s.*, s.type = 'annex' AS annex FROM sections s LEFT JOIN chosen c
  ON c.doc_id = s.doc_id AND c.section_no = s.section_no WHERE s.type = 'annex' OR c.doc_id IS NOT NULL),
counts AS (SELECT doc_id, count(*) FILTER (WHERE annex) AS a, count(*) FILTER (WHERE NOT annex) AS s FROM gone GROUP BY doc_id),
kept AS (SELECT doc_id, count(*) AS kept_lines, string_agg(line, {NL} ORDER BY line_no) AS text FROM judged j
  WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = j.doc_id AND j.line_no BETWEEN g.start_line AND g.end_line)
  GROUP BY doc_id)
SELECT d.doc_id, coalesce(a, 0) AS excluded_annexes, coalesce(s, 0) AS excluded_sections,
coalesce(kept_lines, 0) AS kept_lines, coalesce(k.text, '') AS text,
concat('doc', d.doc_id, '_', coalesce(nullif(concat_ws('_and_', CASE WHEN a > 0 THEN concat('without_', a, '_annexes') END,
CASE WHEN s > 0 THEN concat('without_', s, '_sections') END), ''), 'complete'), '.txt') AS file_name
FROM legal_docs d LEFT JOIN counts USING (doc_id) LEFT JOIN kept k USING (doc_id)"""

# ------------------------------------------------------------------------------------------ tags and footnotes
_CLEAN_BLOCK = f"replace({without('b', P.STRUCTURE_TAG)}, {NL}, ' ')"
TAG_BLOCKS = f"""WITH tagged AS (SELECT page_id AS doc_id, {hits("regexp_replace(html, '<(/?)h[1-6]>', '<\\1h>', 'g')",
P.TAGGED_BLOCK)} AS bs FROM pages), b AS (SELECT doc_id, unnest(range(len(bs)))::INT AS pos, unnest(bs) AS b FROM tagged)
SELECT doc_id, pos, regexp_extract(b, '^<(h|li|p)>', 1) AS tag, {js_trim(_CLEAN_BLOCK)} AS text FROM b"""

TAG_BLOCK_JOIN = f"""WITH {TAGGED_DOCS}, src AS (SELECT doc_id, replace(text, concat('>', {NL}, '<'), '><') AS text
FROM tagged_docs),
notes AS (SELECT doc_id, {hits('text', P.NOTE_TAG, 1)} AS ns, string_split_regex(text, '(?s)<fn>.*?</fn>') AS ps FROM src),
marked AS (SELECT doc_id, ns, array_to_string(list_transform(ps, lambda p, i: CASE WHEN i = 1 THEN p ELSE
  concat('{{{{footnotenumber', i - 1, '}}}}', p) END), '') AS m FROM notes),
items AS (SELECT doc_id, ns, unnest(range(len(bs))) AS k, unnest(bs) AS b FROM (SELECT doc_id, ns,
  {hits('m', P.TAGGED_BLOCK_ONE_LINE + '|[^<]+|<')} AS bs FROM marked)),
follow AS (SELECT *, coalesce(lead(b) OVER (PARTITION BY doc_id ORDER BY k), '') AS nxt FROM items),
joined AS (SELECT doc_id, string_agg(CASE
  WHEN b LIKE '<p>%</p>' THEN concat({js_trim("regexp_replace(b, '</?p>', '', 'g')")},
    CASE WHEN starts_with(nxt, '<p>') THEN {NL} || {NL} ELSE '' END)
  WHEN b LIKE '<li>%</li>' THEN concat({js_trim("regexp_replace(b, '</?li>', '', 'g')")},
    CASE WHEN starts_with(nxt, '<li>') THEN {NL} ELSE '' END)
  WHEN b LIKE '<h>%</h>' THEN concat({js_trim("regexp_replace(b, '</?h>', '', 'g')")}, {NL}, {NL}) ELSE '' END,
  '' ORDER BY k) AS j FROM follow GROUP BY doc_id)
SELECT doc_id, {js_trim(without('j', P.STRUCTURE_TAG))} AS text, len(ns)::BIGINT AS footnote_count,
array_to_string(list_transform(ns, lambda n, i: concat('{{{{footnote', i, '}}}} ',
  {js_trim(f"regexp_replace(n, {q(P.NOTE_LEADING_MARK)}, '')")}, ' {{{{-footnote', i, '}}}}')), {NL}) AS footnotes
FROM joined JOIN marked USING (doc_id)"""

_MARK = f"""coalesce(nullif(regexp_extract(n, {q(P.NOTE_ORIGINAL_MARK)}), ''), concat('[', k, ']'))"""
FOOTNOTE_TAGGING = f"""WITH {TAGGED_DOCS}, blocks AS (SELECT doc_id, text, unnest(range(len(bs))) AS bno, unnest(bs) AS b
  FROM (SELECT doc_id, text, {hits('text', P.TAGGED_BLOCK)} AS bs FROM tagged_docs)),
pieces AS (SELECT doc_id, bno, unnest(range(len(ps))) AS pno, unnest(ps) AS p,
  unnest(list_concat([NULL], ns)) AS n FROM (SELECT doc_id, bno, string_split_regex(c, '(?s)<fn>.*?</fn>') AS ps,
  {hits('c', P.NOTE_TAG, 1)} AS ns FROM (SELECT doc_id, bno, {js_trim(_CLEAN_BLOCK)} AS c FROM blocks))),
counted AS (SELECT *, count(n) OVER (PARTITION BY doc_id ORDER BY bno, pno) AS k FROM pieces),
whole AS (SELECT doc_id, bno, string_agg(CASE WHEN n IS NULL THEN p ELSE concat('{{{{footnotenumber', k, '}}}}', {_MARK},
  '{{{{-footnotenumber', k, '}}}}', p) END, '' ORDER BY pno) AS b FROM counted GROUP BY doc_id, bno),
body AS (SELECT doc_id, string_agg(b, {NL} || {NL} ORDER BY bno) AS body FROM whole GROUP BY doc_id),
defs AS (SELECT doc_id, count(*) AS footnote_count, string_agg(concat('{{{{footnote', k, '}}}}', {js_trim('n')},
  '{{{{-footnote', k, '}}}}'), {NL} ORDER BY k) AS notes FROM counted WHERE n IS NOT NULL GROUP BY doc_id)
SELECT doc_id, {js_trim(f"concat(body, {NL}, {NL}, notes)")} AS text, coalesce(footnote_count, 0) AS footnote_count
FROM body LEFT JOIN defs USING (doc_id)"""

_ID = "coalesce(nullif(ltrim({0}, '0'), ''), '0')"


def renumbered(source: str, name: str) -> str:
    """CTEs ending in ``name(doc_id, text)`` with renumbered footnotes."""
    return f"""{name}_main AS (SELECT doc_id, {without('text', P.NOTE_DEFINITION)} AS m,
  {hits('text', P.NOTE_DEFINITION, 1)} AS ids, {hits('text', P.NOTE_DEFINITION, 2)} AS bodies FROM {source}),
{name}_defs AS (SELECT doc_id, {_ID.format('unnest(ids)')} AS id, {py_strip('unnest(bodies)')} AS body,
  unnest(range(len(ids))) AS pos FROM {name}_main),
{name}_first AS (SELECT doc_id, id, arg_min(body, pos) AS body FROM {name}_defs GROUP BY doc_id, id),
{name}_refs AS (SELECT doc_id, {_ID.format('unnest(rs)')} AS id, unnest(range(1, len(rs) + 1)) AS no
  FROM (SELECT doc_id, {hits('m', P.NOTE_REFERENCE, 1)} AS rs FROM {name}_main)),
{name}_entries AS (SELECT r.doc_id, no, r.id, body FROM {name}_refs r JOIN {name}_first f
  ON f.doc_id = r.doc_id AND f.id = r.id),
{name}_tail AS (SELECT doc_id, string_agg(concat(no, '. ', body, {NL}), '' ORDER BY no) AS tail
  FROM {name}_entries GROUP BY doc_id),
{name}_body AS (SELECT doc_id, ids, array_to_string(list_transform(string_split_regex(m, {q(P.NOTE_REFERENCE)}),
  lambda p, i: CASE WHEN i = 1 THEN p ELSE concat(i - 1, p) END), '') AS b FROM {name}_main),
{name} AS (SELECT doc_id, concat(b, CASE WHEN len(ids) > 0 THEN concat({NL}, {NL}, 'FOOTNOTES:', {NL}, tail)
  ELSE '' END) AS text FROM {name}_body LEFT JOIN {name}_tail USING (doc_id))"""


FOOTNOTE_RENUMBER = f"WITH {FOOTNOTE_DOCS}, {renumbered('footnote_docs', 'renumbered')} SELECT doc_id, text FROM renumbered"
FOOTNOTE_ENTRIES = f"""WITH {FOOTNOTE_DOCS}, {renumbered('footnote_docs', 'renumbered')}
SELECT doc_id, no::INT AS footnote_no, id AS orig_id, body FROM renumbered_entries"""
FOOTNOTE_PAGES = f"""WITH {FOOTNOTE_DOCS}, marked AS (SELECT doc_id // 10 AS doc_id, doc_id % 10 + 1 AS page_no,
{hits('text', P.NOTE_MARKER)} AS ms FROM footnote_docs), found AS (SELECT doc_id, page_no, unnest(ms) AS m FROM marked)
SELECT doc_id, count(DISTINCT page_no) AS pages_with_notes, count(DISTINCT m) AS footnote_count FROM found GROUP BY doc_id"""
FOOTNOTE_PAGE_LIST = f"""WITH {FOOTNOTE_DOCS} SELECT doc_id // 10 AS doc_id, (doc_id % 10 + 1)::INT AS page_no,
len(list_distinct({hits('text', P.NOTE_MARKER)})) AS markers FROM footnote_docs WHERE {hit('text', P.NOTE_MARKER)}"""


def universal_lines(source: str) -> str:
    return (f"SELECT doc_id, unnest(range(len(parts))) AS ln, unnest(parts) AS line, len(parts) AS n FROM (SELECT doc_id, "
            f"string_split_regex(text, {q(P.PY_LINE_BREAK)}) AS parts FROM {source})")


def without_number_lines(source: str, name: str) -> str:
    return f"""{name}_lines AS ({universal_lines(source)}),
{name} AS (SELECT doc_id, coalesce(string_agg(line, {NL} ORDER BY ln) FILTER (WHERE NOT (ln = n - 1 AND line = '')
  AND NOT {hit('line', P.STANDALONE_NUMBER)}), '') AS text FROM {name}_lines GROUP BY doc_id)"""


DROP_NUMBER_LINES = f"WITH {LEGAL_DOCS}, {without_number_lines('legal_docs', 'cleaned')} SELECT doc_id, text FROM cleaned"

# ------------------------------------------------------------------------------------------ legal layout
_TOKEN = f"lower(regexp_extract(s, {q(f'^[^{P.PY_SPACE}]+')}))"
_KEYWORDS = q_list(sorted({*P.UPPER_HEADINGS, *P.TITLE_HEADINGS}))
_STARTS = " OR ".join(f"starts_with(s, {q(w + ' ')})" for w in P.PREAMBLE_STARTERS)


def classified(source: str, name: str) -> str:
    """CTEs ending in ``name(doc_id, line_no, sub_no, type, text)``."""
    return f"""{name}_kept AS (SELECT doc_id, ln, s, {_TOKEN} AS token, lower(s) AS low,
  {hit('s', P.SPLIT_ITEM)} AS is_split FROM (SELECT doc_id, ln, {py_strip('line')} AS s FROM ({universal_lines(source)}))
  WHERE s <> '' AND NOT {hit('s', P.STANDALONE_NUMBER)}),
{name}_base AS (SELECT *, CASE WHEN low = 'preamble' THEN 'PREAMBLE_HEAD' WHEN s = 'Members,' THEN 'PREAMBLE_INTRO'
  WHEN low IN {q_list(P.TRANSITIONS)} THEN 'TRANSITIONAL'
  WHEN token IN {_KEYWORDS} AND (token NOT IN {q_list(P.AMBIGUOUS_HEADINGS)} OR low = token OR {hit('s', P.KEY_AND_ID)})
    THEN CASE WHEN token IN {q_list(P.UPPER_HEADINGS)} THEN 'HEADING_UPPER' ELSE 'HEADING_TITLE' END
  WHEN {hit('s', P.ENUM_MARK)} THEN 'ENUM_MARKER' WHEN {hit('s', P.NUMBERED_HEAD)} THEN 'NUMBERED_PARA_HEAD'
  WHEN {hit('s', P.NUMBER_MARK)} THEN 'NUM_MARKER' WHEN {hit('s', P.QUOTED_NOTE)} THEN 'FOOTNOTE_BLOCK'
  WHEN {hit('s', P.ENUM_ITEM)} THEN 'ENUM_ITEM' WHEN {hit('s', P.NUMBERED_ITEM)} THEN 'NUMBERED_ITEM'
  WHEN ends_with(s, ':') THEN 'ENDS_COLON' ELSE 'REGULAR' END AS kind FROM {name}_kept WHERE NOT is_split),
{name}_both AS (SELECT doc_id, ln, 0 AS sub, s, kind, CASE
  WHEN kind IN ('PREAMBLE_HEAD', 'PREAMBLE_INTRO', 'TRANSITIONAL') THEN kind
  WHEN ({_STARTS}) AND NOT {hit('s', P.ENUM_ITEM)} AND NOT {hit('s', P.NUMBERED_ITEM)} AND token NOT IN {_KEYWORDS}
    THEN 'PREAMBLE_CLAUSE'
  WHEN kind = 'REGULAR' AND NOT {hit('token', P.NUMERAL)} THEN 'PREAMBLE_CLAUSE' ELSE kind END AS kind_inside
  FROM {name}_base
  UNION ALL SELECT doc_id, ln, 0, {py_strip(f"regexp_extract(s, {q(P.SPLIT_ITEM)}, 1)")}, 'SPLIT_MARKER_PARENT',
    'SPLIT_MARKER_PARENT' FROM {name}_kept WHERE is_split
  UNION ALL SELECT doc_id, ln, 1, concat(regexp_extract(s, {q(P.SPLIT_ITEM)}, 2), ' ',
    {py_strip(f"regexp_extract(s, {q(P.SPLIT_ITEM)}, 3)")}), 'ENUM_ITEM', 'ENUM_ITEM' FROM {name}_kept WHERE is_split),
{name}_state AS (SELECT *, coalesce(last_value(CASE WHEN kind IN ('PREAMBLE_HEAD', 'PREAMBLE_INTRO') THEN 1
  WHEN kind_inside = 'PREAMBLE_CLAUSE' THEN NULL ELSE 0 END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ln, sub
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS inside FROM {name}_both),
{name} AS (SELECT doc_id, ln::INT AS line_no, sub AS sub_no, CASE WHEN inside = 1 THEN kind_inside ELSE kind END AS type,
  s AS text FROM {name}_state)"""


def merged(source: str, name: str) -> str:
    """CTEs over typed lines ``source`` ending in ``name`` with both merges done."""
    markers, text = "('ENUM_MARKER', 'NUM_MARKER', 'NUMBERED_PARA_HEAD')", "('REGULAR', 'ENDS_COLON')"
    over = "OVER (PARTITION BY doc_id ORDER BY line_no, sub_no)"
    return f"""{name}_a AS (SELECT *, lead(type) {over} AS t1, lead(text) {over} AS x1, lag(type) {over} AS t0
  FROM {source}),
{name}_b AS (SELECT doc_id, line_no, sub_no,
  CASE WHEN type IN {markers} AND t1 IN {text} THEN CASE type WHEN 'ENUM_MARKER' THEN 'ENUM_ITEM' ELSE 'NUMBERED_ITEM' END
    ELSE type END AS type,
  CASE WHEN type IN {markers} AND t1 IN {text} THEN concat(text, ' ', x1) ELSE text END AS text
  FROM {name}_a WHERE NOT (coalesce(t0 IN {markers}, false) AND type IN {text})),
{name}_c AS (SELECT *, lead(type) {over} AS t1, lead(text) {over} AS x1, lead(type, 2) {over} AS t2 FROM {name}_b),
{name}_d AS (SELECT *, coalesce(type IN ('HEADING_UPPER', 'HEADING_TITLE') AND t1 IN {text} AND t2 NOT IN
  ('HEADING_UPPER', 'HEADING_TITLE', 'PREAMBLE_HEAD', 'TRANSITIONAL', 'SPLIT_MARKER_PARENT')
  AND {hit('text', P.KEY_AND_ID)} AND NOT {hit('x1', P.ITEM_START)}
  AND lower(regexp_extract(x1, {q(f'^[^{P.PY_SPACE}]+')})) NOT IN {_KEYWORDS}, false) AS takes FROM {name}_c),
{name}_e AS (SELECT *, coalesce(lag(takes) {over}, false) AS taken FROM {name}_d),
{name} AS (SELECT doc_id, line_no, sub_no, type, CASE WHEN takes THEN concat(text, ' ', x1) ELSE text END AS text
  FROM {name}_e WHERE NOT taken)"""


def rendered(docs: str, source: str, name: str) -> str:
    return f"""{name}_text AS (SELECT doc_id, string_agg(concat(CASE WHEN type IN ('PREAMBLE_HEAD', 'TRANSITIONAL',
  'HEADING_UPPER', 'HEADING_TITLE', 'FOOTNOTE_BLOCK') THEN {NL} || {NL} WHEN type = 'NUMBERED_PARA_HEAD' THEN {NL}
  ELSE '' END, CASE WHEN type IN ('PREAMBLE_HEAD', 'HEADING_UPPER') THEN replace(upper(text), 'ẞ', 'SS') ELSE text END),
  {NL} ORDER BY line_no, sub_no) AS text FROM {source} GROUP BY doc_id),
{name} AS (SELECT d.doc_id, coalesce(t.text, '') AS text FROM {docs} d LEFT JOIN {name}_text t USING (doc_id))"""


_TYPED = f"{LEGAL_DOCS}, {classified('legal_docs', 'typed')}"
_MERGED = f"{_TYPED}, {merged('typed', 'merged')}"
ALIGN_LINE_TYPES = f"WITH {_TYPED} SELECT doc_id, line_no, sub_no, type, text FROM typed"
ALIGN_MERGE = f"WITH {_MERGED} SELECT doc_id, line_no, sub_no, type, text FROM merged"
ALIGN_RENDER = f"WITH {_MERGED}, {rendered('legal_docs', 'merged', 'aligned')} SELECT doc_id, text FROM aligned"
PIPELINE_TEXT = f"""WITH {FOOTNOTE_DOCS}, {renumbered('footnote_docs', 'renumbered')},
{classified('renumbered', 'typed')}, {merged('typed', 'merged')}, {rendered('renumbered', 'merged', 'aligned')},
{without_number_lines('aligned', 'cleaned')} SELECT doc_id, text FROM cleaned"""
DOCUMENT_PIPELINE = f"""WITH {CORRECTED}, source_docs AS (SELECT doc_id, text FROM corrected),
{renumbered('source_docs', 'renumbered')}, {classified('renumbered', 'typed')}, {merged('typed', 'merged')},
{rendered('renumbered', 'merged', 'aligned')}, {without_number_lines('aligned', 'cleaned')}
SELECT doc_id, 0::BIGINT AS part_no, text FROM cleaned"""
