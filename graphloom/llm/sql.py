"""DuckDB SQL for the queries that SQL can state."""

OP2 = r"""
WITH t AS (
  SELECT page_id, regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1) AS h,
         regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', chr(10), 'g') AS x FROM pages),
u AS (SELECT page_id, nullif(h, '') AS site,
         regexp_replace(regexp_replace(x, '(?i)</?(?:b|i|u|em|strong|span|a|code|sup|sub)(?:\s[^>]*)?>', '', 'g'), '<[^>]*>', chr(10), 'g') AS x FROM t),
v AS (SELECT row_number() OVER () AS r, page_id, site,
         string_split(regexp_replace(regexp_replace(x, '[ \t\r\n]*\n[ \t\r\n]*', chr(10), 'g'), '^\n|\n$', '', 'g'), chr(10)) AS lines FROM u),
l AS (SELECT DISTINCT r, site, unnest(lines) AS line FROM v),
c AS (SELECT site, line, count(*) AS n FROM l WHERE trim(line, ' ') <> '' GROUP BY site, line),
s AS (SELECT site, count(*) AS pages FROM v GROUP BY site),
b AS (SELECT c.site, list(c.line) AS bad FROM c JOIN s ON c.site IS NOT DISTINCT FROM s.site
      WHERE n >= 5 AND n > 0.1::DOUBLE * pages GROUP BY c.site),
k AS (SELECT v.*, list_filter(lines, lambda z: NOT coalesce(list_contains(bad, z), false)) AS kept
      FROM v LEFT JOIN b ON v.site IS NOT DISTINCT FROM b.site)
SELECT page_id, site, coalesce(len(lines), 0)::BIGINT AS n_lines,
       coalesce(len(lines) - len(kept), 0)::BIGINT AS n_dropped,
       CASE WHEN kept IS NOT NULL AND len(kept) = 0 THEN '' ELSE array_to_string(kept, chr(10)) END AS clean_text FROM k
"""

OP3 = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       coalesce(doc_id = max(doc_id) OVER w, false) AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY sha256(coalesce(text, '')))
"""

OP8 = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 10))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rk FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][((rk - 1) % 3 + 1)::INT]::BIGINT AS w, (SELECT sum(source_size) FROM s)::BIGINT AS whole FROM s),
r AS (SELECT max((150 * whole - 200 * cut)::DOUBLE / (100 * free)::DOUBLE) AS rate FROM (
  SELECT whole, coalesce(sum(source_size) OVER o, 0)::BIGINT AS cut,
         (sum(w) OVER () - coalesce(sum(w) OVER o, 0))::BIGINT AS free
  FROM w WINDOW o AS (ORDER BY source_size::DOUBLE / w, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))),
t AS (SELECT source, source_size, least(2.0::DOUBLE * source_size, rate * w) AS target FROM w, r),
f AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS copies FROM t),
g AS (SELECT *, target - copies * source_size AS rest FROM f),
c AS (SELECT source, h, sum(size)::BIGINT AS words FROM d GROUP BY source, h),
u AS (SELECT c.source, h, words, rest, sum(words) OVER (PARTITION BY c.source ORDER BY h) AS upto
      FROM c JOIN g ON c.source IS NOT DISTINCT FROM g.source),
e AS (SELECT source, min(CASE WHEN upto > rest THEN h END) AS edge, arg_min(words, h) FILTER (upto > rest) AS words,
             any_value(rest) - coalesce(max(CASE WHEN upto <= rest THEN upto END), 0) AS rest FROM u GROUP BY source),
m AS (SELECT source, coalesce(edge + CASE WHEN 2 * rest >= words THEN 1 ELSE 0 END, 1099511627776) AS lim FROM e)
SELECT d.doc_id, d.size, g.source_size, g.target,
       (d.size * (g.copies + CASE WHEN g.rest > 0 AND d.h < m.lim THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source JOIN m ON d.source IS NOT DISTINCT FROM m.source
"""

OP9 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (
    SELECT conv_id, turn, role, text FROM conversations UNION ALL
    SELECT * FROM (VALUES (-7::BIGINT, 0::BIGINT, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')))),
u AS (SELECT *, row_number() OVER w AS k, coalesce(lag(role) OVER w <> role, true) AS opens,
             length(replace(replace(replace(text, '\', '\\'), '<', '<\'), '[', '[\')) AS chars,
             length(replace(replace(replace(role, '\', '\\'), '<', '<\'), '[', '[\')) AS head
      FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
g AS (SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '') AS loss,
       sum(chars) + sum(CASE WHEN opens THEN 20 + head ELSE 5 END) AS formatted_chars FROM u GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256,
       formatted_chars::BIGINT AS formatted_chars FROM g
"""

OP11 = r"""
WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 1),
                                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
r AS (SELECT * FROM (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
                            ('net', '/es/', 'block'), ('net', '/fr/', 'block')) AS r(rule_host, rule_path, verdict)),
p AS (SELECT DISTINCT host, path FROM u),
m AS (SELECT host, path, rule_host || rule_path AS rule, verdict,
             row_number() OVER (PARTITION BY host, path ORDER BY length(rule_host) DESC, length(rule_path) DESC) AS k
      FROM p JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT u.page_id, u.host, u.path, m.rule, coalesce(m.verdict, 'allow') AS verdict
FROM u LEFT JOIN m ON m.host = u.host AND m.path = u.path AND m.k = 1
"""

OP13 = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (
  SELECT lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                            '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
o AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM p),
f1 AS (SELECT lang, w[i] AS a, count(*) AS f FROM o GROUP BY ALL),
f2 AS (SELECT lang, w[i] AS a, w[i + 1] AS b, count(*) AS f FROM o WHERE i + 1 <= len(w) GROUP BY ALL HAVING count(*) >= 10),
f3 AS (SELECT lang, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c, count(*) AS f FROM o WHERE i + 2 <= len(w) GROUP BY ALL HAVING count(*) >= 10),
c AS (
  SELECT f2.lang, f2.a || ' ' || f2.b AS phrase, f2.f AS a, 1 AS k, l.f AS l, r.f AS r
  FROM f2 JOIN f1 l ON l.lang = f2.lang AND l.a = f2.a JOIN f1 r ON r.lang = f2.lang AND r.a = f2.b
  WHERE NOT EXISTS (SELECT 1 FROM f3 WHERE f3.lang = f2.lang AND f3.a = f2.a AND f3.b = f2.b AND 100 * f3.f >= 50 * f2.f)
    AND NOT EXISTS (SELECT 1 FROM f3 WHERE f3.lang = f2.lang AND f3.b = f2.a AND f3.c = f2.b AND 100 * f3.f >= 50 * f2.f)
  UNION ALL
  SELECT f3.lang, f3.a || ' ' || f3.b || ' ' || f3.c, f3.f, 1, l.f, r.f
  FROM f3 JOIN f1 l ON l.lang = f3.lang AND l.a = f3.a JOIN f2 r ON r.lang = f3.lang AND r.a = f3.b AND r.b = f3.c
  UNION ALL
  SELECT f3.lang, f3.a || ' ' || f3.b || ' ' || f3.c, f3.f, 2, l.f, r.f
  FROM f3 JOIN f2 l ON l.lang = f3.lang AND l.a = f3.a AND l.b = f3.b JOIN f1 r ON r.lang = f3.lang AND r.a = f3.c),
s AS (SELECT *, ((1000000::HUGEINT * a * a) // (l::HUGEINT * r))::BIGINT AS score FROM c),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
t AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f1 GROUP BY lang)
SELECT t.lang, t.rank, t.phrase, t.a, t.l, t.r, n.n, t.score FROM t JOIN n ON n.lang = t.lang WHERE rank <= 2000
"""

ORACLE = {"op2_line_dedup": OP2, "op3_exact_dedup": OP3, "op8_mix_sources": OP8, "op9_chat_format": OP9,
          "op11_url_filter": OP11, "op13_phrase_mining": OP13}
