"""SQL twins, with literals of their own."""

from __future__ import annotations

CHAT = r"""
WITH extra AS (SELECT -7::BIGINT AS conv_id, t AS turn, CASE t WHEN 0 THEN 'user' ELSE 'assistant' END AS role,
                      '\### Assistant: </turn> ok' AS text FROM (VALUES (0), (1)) v(t)),
rows_ AS (SELECT conv_id::BIGINT AS conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
          UNION ALL SELECT * FROM extra),
sized AS (SELECT *, length(role) + length(text) + length('<></turn>') + 1
              + length(regexp_replace(role || text, '[^<>\\]', '', 'g')) AS chars FROM rows_)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""

RULES = r"""
WITH worded AS (
    SELECT doc_id::BIGINT AS doc_id, lang, source, coalesce(text, '') AS text,
           list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\v\f\r]+'), lambda x: x <> '') AS w FROM documents),
windows AS (
    SELECT row_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s
    FROM (SELECT row_number() OVER () AS row_id, w, unnest(range(1, len(w) - 1)) AS i
          FROM (SELECT w FROM worded ORDER BY doc_id) WHERE len(w) >= 3)),
ids AS (SELECT row_number() OVER () AS row_id, doc_id FROM (SELECT doc_id FROM worded WHERE len(w) >= 3 ORDER BY doc_id)),
twice AS (SELECT row_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY row_id, s) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice JOIN ids USING (row_id), (VALUES (0), (1), (2)) v(k) GROUP BY 1),
counts AS (
    SELECT d.doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
           length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
           length(regexp_replace(text, '[^A-Z]', '', 'g'))::BIGINT AS n_capitals,
           list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\v\f\r]')) AS l,
           coalesce(c.n, 0) AS n_repeat_words
    FROM worded d LEFT JOIN covered c USING (doc_id)),
shares AS (
    SELECT *, len(l)::BIGINT - len(list_distinct(l))::BIGINT AS n_dup_lines,
           n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
           n_symbols * 1000000 // greatest(word_chars, 1) AS symbols,
           (len(l) - len(list_distinct(l))) * 1000000 // greatest(len(l), 1) AS repeated_lines,
           n_repeat_words * 1000000 // greatest(n_words, 1) AS repeated_words,
           n_capitals * 1000000 // greatest(word_chars, 1) AS capitals,
           word_chars * 1000 // greatest(n_words, 1) AS word_length FROM counts),
long AS (
    SELECT doc_id, lang, source, m, v FROM (SELECT * FROM shares WHERE NOT base_failed)
    UNPIVOT (v FOR m IN (symbols, repeated_lines, repeated_words, capitals, word_length))),
own AS (SELECT lang, source, m, count(*) AS n, quantile_disc(v, [0.25, 0.5, 0.75]) AS q FROM long GROUP BY ALL),
wide AS (SELECT lang, m, count(*) AS k, quantile_disc(v, [0.1, 0.25, 0.5, 0.75, 0.9]) AS w FROM long GROUP BY ALL),
whole AS (SELECT m, quantile_disc(v, [0.1, 0.25, 0.5, 0.75, 0.9]) AS a FROM long GROUP BY ALL),
chosen AS (SELECT o.lang, o.source, o.m, CASE WHEN n >= 30 THEN q WHEN k >= 30 THEN w[2:4] ELSE a[2:4] END AS q,
                  CASE WHEN k >= 300 THEN w[5] - w[4] ELSE a[5] - a[4] END AS above,
                  CASE WHEN k >= 300 THEN w[2] - w[1] ELSE a[2] - a[1] END AS below
           FROM own o JOIN wide w ON o.m = w.m AND o.lang IS NOT DISTINCT FROM w.lang JOIN whole a ON a.m = o.m),
ends AS (SELECT lang, source, m, q[3] + 8 * greatest(q[3] - q[2], above, q[2] // 50) AS most,
                q[1] - 8 * greatest(q[2] - q[1], below, q[2] // 50) AS least FROM chosen),
-- counts that a share is of, the whole, and how many come at once
counted AS (
    SELECT shares.*, m, v, CASE m WHEN 'symbols' THEN n_symbols WHEN 'capitals' THEN n_capitals WHEN 'repeated_lines' THEN n_dup_lines
                     WHEN 'repeated_words' THEN n_repeat_words END AS c,
           CASE m WHEN 'repeated_lines' THEN len(l) WHEN 'repeated_words' THEN n_words ELSE word_chars END AS t,
           CASE m WHEN 'repeated_words' THEN 27.0::DOUBLE ELSE 9.0::DOUBLE END AS chance
    FROM long JOIN shares USING (doc_id)),
beyond AS (SELECT k.*, most, least, c::DOUBLE - (most * t)::DOUBLE / 1e6::DOUBLE AS x
           FROM counted k JOIN ends e ON e.m = k.m AND e.lang IS NOT DISTINCT FROM k.lang AND e.source IS NOT DISTINCT FROM k.source),
judged AS (
    SELECT doc_id, bool_and(CASE WHEN m = 'word_length' THEN v BETWEEN least AND most
                                 ELSE x <= 0 OR x * x <= chance * c END) AS good
    FROM beyond GROUP BY 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(good, false) AS kept
FROM shares LEFT JOIN judged USING (doc_id)
"""


def _level(parent: str, name: str, keys: str, up: str, above: str) -> str:
    """One level of shrinkage: counts, the strength of its prior, posterior means."""
    return f"""
{name}_n AS (SELECT {keys}, count(bad) AS n, coalesce(sum(bad::INT), 0)::BIGINT AS bad FROM pages_ GROUP BY ALL),
{name}_s AS (
    SELECT CASE WHEN n IS NULL OR k <= up_k THEN 200.0 WHEN between_ <= 0 THEN 200.0
                ELSE least(200.0, greatest(2.0, chance / between_ - 1)) END AS strength
    FROM (SELECT *, ((squares - above) / 1000000 - (k - up_k) * chance) / greatest(1e-9, n - part / 1000000) AS between_
          FROM (SELECT *, (bad::DOUBLE / n) * (1 - bad::DOUBLE / n) AS chance FROM
              (SELECT sum(c.bad * c.bad * 1000000 // c.n)::DOUBLE AS squares, sum(c.n * c.n * 1000000 // p.n)::DOUBLE AS part,
                      sum(c.n)::DOUBLE AS n, sum(c.bad)::DOUBLE AS bad, count(*) AS k
               FROM {name}_n c JOIN {parent}_n p USING ({up}) WHERE c.n > 0 AND p.n > 0),
              (SELECT sum(bad * bad * 1000000 // n)::DOUBLE AS above, count(*) AS up_k FROM {parent}_n WHERE n > 0)))),
{name}_p AS (
    SELECT c.*, p.mean AS prior, s.strength, (c.bad + s.strength * p.mean) / (c.n + s.strength) AS mean
    FROM {name}_n c JOIN {above} p USING ({up}), {name}_s s),"""


REPUTATION = r"""
WITH rests AS (
    SELECT page_id::BIGINT AS page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
    FROM pages),
parsed AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                     'abcdefghijklmnopqrstuvwxyz') AS host,
                  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rests),
told AS (SELECT doc_id, bool_or(coalesce(quality, 1) = 0 OR coalesce(toxic, 0) = 1) AS bad FROM labels
         WHERE doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL) GROUP BY 1),
pages_ AS (
    SELECT page_id, host, path, bad, 0 AS world, split_part(host, '.', -1) AS suffix,
           array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') AS domain
    FROM parsed LEFT JOIN told ON told.doc_id = TRY_CAST(regexp_extract(path, '/([0-9]+)', 1) AS BIGINT)),
world_n AS (SELECT world, count(bad) AS n, coalesce(sum(bad::INT), 0)::BIGINT AS bad FROM pages_ GROUP BY ALL),
world_p AS (SELECT *, (bad + 0.5::DOUBLE) / (n + 1) AS mean FROM world_n),""" + _level(
    "world", "suffix", "world, suffix", "world", "world_p") + _level(
    "suffix", "domain", "world, suffix, domain", "world, suffix", "suffix_p") + _level(
    "domain", "host", "world, suffix, domain, host", "world, suffix, domain", "domain_p") + r"""
bounds AS (
    SELECT host, mean - 1.64::DOUBLE * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS bound
    FROM (SELECT host, mean, bad + strength * prior AS a, n - bad + strength * (1 - prior) AS b FROM host_p)),
rules (r, h, p, v) AS (VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
    ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
fits AS (SELECT page_id, arg_max(r, length(r)) AS rule, arg_max(v, length(r)) AS v FROM parsed JOIN rules
         ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY 1)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN bound > 0.35 THEN 'block' ELSE 'allow' END) AS verdict,
       round(bound, 6) AS bound
FROM pages_ LEFT JOIN fits USING (page_id) JOIN bounds USING (host)
"""

FILL_IN_MIDDLE = r"""
WITH hashed AS (
    SELECT doc_id::BIGINT AS doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h,
           regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS t FROM documents),
drawn AS (
    SELECT *, len(t) AS n, ('0x' || h[1:8])::BIGINT % (len(t) + 1) AS a, ('0x' || h[9:16])::BIGINT % (len(t) + 1) AS b,
           CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                     OR ('0x' || h[17:24])::BIGINT % 100 >= 90 THEN 'plain'
                WHEN ('0x' || h[25:32])::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM hashed),
cut AS (
    SELECT *, array_to_string(t[1:least(a, b)], '') AS p, array_to_string(t[least(a, b) + 1:greatest(a, b)], '') AS m,
           array_to_string(t[greatest(a, b) + 1:], '') AS s FROM drawn)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                   ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
FROM cut
"""

HARD_NEGATIVES = r"""
WITH fine AS (
    SELECT vec_id::BIGINT AS id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END)::BIGINT AS label,
           list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
    SELECT a.id AS anchor_id, b.id AS other_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
    FROM fine a, fine b WHERE a.id % 100 = 0 AND a.id <> b.id),
positives AS (
    SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM pairs WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id,
       (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id))::INT AS rank,
       other_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN pairs USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) <= 10
"""
