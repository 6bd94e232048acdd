"""DuckDB SQL for each registered query (same column names as the Spark side)."""

from __future__ import annotations

from graphloom.plans import sqlviews as sv
from graphloom.sources.fixtures import QUESTION_FORMS

ORACLE: dict[str, str] = {}


def _walk(root_table: str, direction: str, depth: int, include_fringe: bool = False) -> str:
    return ",\n".join([sv.ENT_NODES, sv.ENT_EDGES, sv.roots_cte(root_table),
                       sv.arcs_cte(direction), sv.bfs_ctes(depth, include_fringe)])


ORACLE["blast_radius_regions"] = f"""
WITH {_walk('region', 'inbound', 3)}
SELECT root_id, hop, type, confidence, COUNT(*) AS n_edges
FROM ({sv.visited_edges_sql('inbound', 3)}) e
GROUP BY root_id, hop, type, confidence
"""

ORACLE["traverse_outbound_orders"] = f"""
WITH {_walk('orders', 'outbound', 3)}
SELECT root_id, edge_id, hop FROM ({sv.visited_edges_sql('outbound', 3)}) e
"""

ORACLE["traverse_both_nations"] = f"""
WITH {_walk('nation', 'both', 2)}
SELECT root_id, edge_id, hop, times_seen FROM ({sv.visited_edges_sql('both', 2)}) e
"""

ORACLE["traverse_fringe"] = f"""
WITH {_walk('region', 'inbound', 2, include_fringe=True)}
SELECT vis.root_id, vis.node_id, vis.hop FROM vis
WHERE vis.node_id IN (SELECT node_id FROM ent_nodes)
"""

ORACLE["weakest_path_confidence"] = f"""
WITH {_walk('region', 'inbound', 3)}
SELECT root_id, hop,
       CASE wt WHEN 0 THEN 'deterministic' WHEN 1 THEN 'probabilistic' ELSE 'inferred' END
         AS weakest_confidence,
       COUNT(*) AS n_nodes
FROM vis WHERE node_id IN (SELECT node_id FROM ent_nodes)
GROUP BY root_id, hop, wt
"""

ORACLE["connect_pairs"] = f"""
WITH {sv.ENT_EDGES},
adj AS (
  SELECT DISTINCT source_node_id AS u, target_node_id AS v FROM ent_edges
  UNION SELECT DISTINCT target_node_id AS u, source_node_id AS v FROM ent_edges
),
pairs AS (
  SELECT DISTINCT 'c:' || CAST(o.o_custkey AS VARCHAR) AS a, 's:' || CAST(l.l_suppkey AS VARCHAR) AS b
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
)
SELECT p.a, p.b, CAST(NULL AS VARCHAR) AS via, 1 AS hops
FROM pairs p JOIN adj ON adj.u = p.a AND adj.v = p.b
UNION ALL
SELECT p.a, p.b, x.v AS via, 2 AS hops
FROM pairs p JOIN adj x ON x.u = p.a JOIN adj y ON y.u = x.v AND y.v = p.b
WHERE x.v <> p.a AND x.v <> p.b
"""

ORACLE["degrees_density"] = f"""
WITH {sv.ENT_NODES}, {sv.ENT_EDGES}
SELECT n.node_id,
       COALESCE(o.c, 0) AS out_degree, COALESCE(i.c, 0) AS in_degree,
       COALESCE(o.c, 0) + COALESCE(i.c, 0) AS degree
FROM (SELECT DISTINCT node_id FROM ent_nodes) n
LEFT JOIN (SELECT source_node_id AS id, COUNT(*) AS c FROM ent_edges GROUP BY 1) o ON o.id = n.node_id
LEFT JOIN (SELECT target_node_id AS id, COUNT(*) AS c FROM ent_edges GROUP BY 1) i ON i.id = n.node_id
"""

ORACLE["graph_summary"] = f"""
WITH {sv.ENT_NODES}, {sv.ENT_EDGES},
d AS (
  SELECT n.node_id, COALESCE(o.c, 0) + COALESCE(i.c, 0) AS degree
  FROM (SELECT DISTINCT node_id FROM ent_nodes) n
  LEFT JOIN (SELECT source_node_id AS id, COUNT(*) AS c FROM ent_edges GROUP BY 1) o ON o.id = n.node_id
  LEFT JOIN (SELECT target_node_id AS id, COUNT(*) AS c FROM ent_edges GROUP BY 1) i ON i.id = n.node_id)
SELECT (SELECT COUNT(*) FROM d) AS n_nodes,
       (SELECT COUNT(*) FROM ent_edges) AS n_edges,
       round((SELECT COUNT(*) FROM ent_edges) / (SELECT COUNT(*) FROM d), 6) AS edge_density,
       (SELECT COUNT(*) FROM d WHERE degree = 0) AS n_isolated
"""

ORACLE["edge_type_confidence_cube"] = f"""
WITH {sv.ENT_EDGES}
SELECT type, confidence, COUNT(*) AS n_edges FROM ent_edges GROUP BY CUBE (type, confidence)
"""

ORACLE["edge_type_summary"] = f"""
WITH {sv.ENT_EDGES}
SELECT array_to_string(list_sort(list_distinct(list(type))), ', ') AS edge_types,
       count(*) FILTER (WHERE confidence = 'deterministic') AS n_deterministic,
       count(*) FILTER (WHERE confidence = 'probabilistic') AS n_probabilistic,
       count(*) FILTER (WHERE confidence = 'inferred') AS n_inferred,
       count(*) FILTER (WHERE confidence IS NULL OR confidence NOT IN
                        ('deterministic', 'probabilistic', 'inferred')) AS n_invalid
FROM ent_edges
"""

ORACLE["simple_graph"] = f"""
WITH {sv.ENT_NODES}, {sv.ENT_EDGES}
SELECT DISTINCT least(source_node_id, target_node_id) AS src,
       greatest(source_node_id, target_node_id) AS dst
FROM ent_edges
WHERE source_node_id IN (SELECT node_id FROM ent_nodes)
  AND target_node_id IN (SELECT node_id FROM ent_nodes)
"""


def _topk_sql(score_expr: str, order: str) -> str:
    return f"""
WITH emb AS (SELECT vec_id, 'doc:' || CAST(vec_id AS VARCHAR) AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
p AS (SELECT a.id AS query_id, b.id AS item_id, {score_expr} AS score
      FROM emb a JOIN emb b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score {order}, item_id)
                     AS INTEGER) AS rank FROM p)
SELECT query_id, item_id, round(score, 6) AS score, rank FROM r WHERE rank <= 5
"""


ORACLE["vector_topk_dot"] = _topk_sql("list_dot_product(a.v, b.v)", "DESC")
ORACLE["vector_topk_l2"] = _topk_sql("list_distance(a.v, b.v)", "ASC")
ORACLE["vector_topk_cosine"] = _topk_sql("list_cosine_similarity(a.v, b.v)", "DESC")

ORACLE["vector_topk_communities"] = """
WITH x AS (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x,
                  generate_subscripts(embedding, 1) AS pos FROM embeddings),
cent AS (SELECT label, list(m ORDER BY pos) AS v
         FROM (SELECT label, pos, avg(x) AS m FROM x GROUP BY label, pos) t GROUP BY label),
p AS (SELECT e.vec_id AS query_id, c.label AS community,
             list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), c.v) AS score
      FROM embeddings e JOIN cent c ON TRUE),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, community)
                     AS INTEGER) AS rank FROM p)
SELECT query_id, CAST(community AS BIGINT) AS community, round(score, 6) AS score, rank
FROM r WHERE rank <= 3
"""

ORACLE["knn_graph"] = f"""
WITH {sv.KNN}
SELECT src, dst, round(score, 6) AS score FROM knn
"""

_MODULARITY = """SELECT COUNT(*) AS n_communities, (SELECT COUNT(*) FROM dup) AS n_edges,
       round(SUM(l_c) / (SELECT COUNT(*) FROM dup)
             - SUM(CAST(d_c AS DOUBLE) * d_c) / (4.0 * (SELECT COUNT(*) FROM dup) * (SELECT COUNT(*) FROM dup)), 9)
         AS modularity
FROM per"""

_PER_COMMUNITY = """lc AS (SELECT a.comm, COUNT(*) AS l_c FROM dup JOIN lab a ON a.id = dup.src
       JOIN lab b ON b.id = dup.dst WHERE a.comm = b.comm GROUP BY a.comm),
dc AS (SELECT lab.comm, COUNT(*) AS d_c
       FROM (SELECT src AS id FROM dup UNION ALL SELECT dst FROM dup) e JOIN lab ON lab.id = e.id
       GROUP BY lab.comm),
per AS (SELECT c.comm, COALESCE(l_c, 0) AS l_c, COALESCE(d_c, 0) AS d_c
        FROM (SELECT DISTINCT comm FROM lab) c LEFT JOIN lc ON lc.comm = c.comm
        LEFT JOIN dc ON dc.comm = c.comm)"""

ORACLE["modularity_labels"] = f"""
WITH {sv.DUP},
lab AS (SELECT doc_id AS id, lang AS comm FROM documents),
{_PER_COMMUNITY}
{_MODULARITY}
"""

ORACLE["connected_components"] = f"""
WITH RECURSIVE {sv.DUP},
adj AS (SELECT src AS u, dst AS v FROM dup UNION SELECT dst, src FROM dup),
reach(id, r) AS (
  SELECT DISTINCT u, u FROM adj
  UNION
  SELECT reach.id, adj.v FROM reach JOIN adj ON adj.u = reach.r)
SELECT id, MIN(r) AS component FROM reach GROUP BY id
"""

# every document once, no community across components, modularity not below the components' own
ORACLE["louvain_invariants"] = f"""
WITH RECURSIVE {sv.DUP}, {sv.DUP_COMPONENTS},
lab AS (SELECT id, component AS comm FROM comp),
{_PER_COMMUNITY}, q AS ({_MODULARITY})
SELECT (SELECT COUNT(*) FROM documents) AS n_nodes, (SELECT COUNT(*) FROM documents) AS n_assigned,
       CAST(0 AS BIGINT) AS n_mixed, modularity AS component_modularity, true AS modularity_ok FROM q
"""

ORACLE["corrections_capture"] = f"""
WITH {sv.COR}
SELECT correction_id, session_id, target_type, target_id, original, corrected FROM cor
"""

ORACLE["corrections_search"] = f"""
WITH {sv.COR}, {sv.QWORDS}
{sv.search_sql()}
"""

ORACLE["correction_postings"] = f"""
WITH {sv.COR}, {sv.QWORDS}, m AS ({sv.search_sql().replace('SELECT DISTINCT qw.question_id, c.correction_id', 'SELECT DISTINCT qw.question_id, qw.word, c.correction_id')})
SELECT word, correction_id, COUNT(*) AS n_questions FROM m GROUP BY word, correction_id
"""

ORACLE["corrections_by_source"] = f"""
WITH {sv.COR}
SELECT d.source AS source_file, 'doc:' || CAST(d.doc_id AS VARCHAR) AS node_id,
       c.correction_id, c.original, c.corrected
FROM cor c
JOIN documents d ON d.doc_id = c.conv_id % (SELECT COUNT(*) FROM documents)
"""

ORACLE["correction_before_after"] = f"""
WITH {sv.COR}, {sv.QWORDS}
({sv.search_sql()})
EXCEPT
({sv.search_sql('turn < 4')})
"""

ORACLE["runlog_aggregate"] = f"WITH {sv.RUN}\n{sv.rollup_sql('orchestrator_model')}"
ORACLE["runlog_aggregate_sprint"] = f"WITH {sv.RUN}\n{sv.rollup_sql('sprint')}"

ORACLE["runlog_filter"] = f"""
WITH {sv.RUN}
SELECT event_id, sprint, prompt_version, suite_version, orchestrator_model, passed FROM runs
WHERE prompt_version = 'v003' AND starts_with(COALESCE(suite_version, ''), 'click')
  AND contains(COALESCE(orchestrator_model, ''), '-1') AND passed IS TRUE
"""

ORACLE["runlog_failed_canonical"] = f"""
WITH {sv.RUN}
SELECT event_id, sprint, passed, canonical FROM runs
WHERE sprint = 'view' AND passed IS FALSE AND canonical IS TRUE
"""

ORACLE["run_numbers"] = """
SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS run_num FROM events
"""

ORACLE["suite_fingerprint"] = """
WITH f AS (
  SELECT source, lang, sha256(CAST(doc_id AS VARCHAR) || ':' || chr(10) || COALESCE(text, '')) AS h
  FROM documents),
s AS (
  SELECT source, lang, COUNT(*) AS n_files,
         SUM(CAST(('0x' || substr(h, 1, 15)) AS HUGEINT)) AS s_hi,
         SUM(CAST(('0x' || substr(h, 16, 15)) AS HUGEINT)) AS s_lo
  FROM f GROUP BY source, lang),
fp AS (
  SELECT source, lang, n_files,
         substr(sha256(CAST(n_files AS VARCHAR) || '|' || CAST(s_hi AS VARCHAR) || '|'
                       || CAST(s_lo AS VARCHAR)), 1, 8) AS fingerprint
  FROM s),
ver AS (
  SELECT source, fingerprint, MIN(lang) AS first_seen FROM fp GROUP BY source, fingerprint)
SELECT fp.source, fp.lang, fp.n_files, fp.fingerprint,
       fp.source || '_v' || lpad(CAST(row_number() OVER (PARTITION BY ver.source
                                   ORDER BY ver.first_seen, ver.fingerprint) AS VARCHAR), 3, '0')
         AS version
FROM fp JOIN ver ON ver.source = fp.source AND ver.fingerprint = fp.fingerprint
"""

ORACLE["version_notes"] = """
WITH p AS (SELECT conv_id AS suite, turn AS v, role AS name, text AS content FROM conversations),
vs AS (SELECT DISTINCT suite, v FROM p),
f AS (SELECT suite, MIN(v) AS v0 FROM p GROUP BY suite),
items AS (
  SELECT c.suite, c.v, c.name,
         CASE WHEN prev.content IS NULL AND EXISTS (SELECT 1 FROM p x WHERE x.suite = c.suite AND x.v = c.v - 1)
                THEN c.name || ' (new)'
              WHEN prev.content IS NOT NULL AND prev.content <> c.content
                THEN c.name || ' (' || printf('%+d', length(c.content) - length(prev.content)) || ' chars)'
         END AS item
  FROM p c LEFT JOIN p prev ON prev.suite = c.suite AND prev.v = c.v - 1 AND prev.name = c.name),
ch AS (SELECT suite, v, string_agg(item, ', ' ORDER BY name, item) AS items
       FROM items WHERE item IS NOT NULL GROUP BY suite, v)
SELECT vs.suite, vs.v AS version_no,
       CASE WHEN vs.v = f.v0 THEN 'Initial prompt snapshot.'
            WHEN ch.items IS NOT NULL THEN 'Changed: ' || ch.items || '.'
            ELSE 'No detected changes.' END AS note
FROM vs JOIN f ON f.suite = vs.suite LEFT JOIN ch ON ch.suite = vs.suite AND ch.v = vs.v
"""

ORACLE["community_members"] = f"""
WITH RECURSIVE {sv.DUP}, {sv.DUP_COMPONENTS}
SELECT m.community_id, m.level, m.n_members, m.node_id, d.source AS source_file,
       CASE WHEN d.doc_id IS NULL THEN NULL ELSE 'document' END AS chunk_type,
       substring(COALESCE(d.text, ''), 1, 400) AS summary
FROM members m LEFT JOIN documents d ON d.doc_id = m.doc_id
"""

ORACLE["membership_writeback"] = f"""
WITH RECURSIVE {sv.DUP}, {sv.DUP_COMPONENTS}
SELECT 'doc:' || CAST(d.doc_id AS VARCHAR) AS node_id, m.community_id
FROM documents d LEFT JOIN members m ON m.doc_id = d.doc_id
"""


def _html_part(kind: str, pattern: str) -> str:
    return f"""SELECT page_id, '{kind}' AS chunk_type, CAST(pos AS INTEGER) AS ordinal, m[pos] AS content
FROM (SELECT page_id, regexp_extract_all(html, '{pattern}', 1) AS m FROM pages) p,
     LATERAL (SELECT unnest(generate_series(1, len(p.m))) AS pos) g"""


ORACLE["html_chunks"] = "\nUNION ALL\n".join([
    _html_part("title", "(?is)<title[^>]*>(.*?)</title>"),
    _html_part("heading", "(?is)<h[1-6][^>]*>(.*?)</h[1-6]>"),
    _html_part("link", sv.LINK_RX),
    _html_part("paragraph", "(?is)<p(?:\\s[^>]*)?>(.*?)</p>"),
])

ORACLE["unresolved_links"] = f"""
WITH {sv.LNK}
SELECT type, confidence, COUNT(*) AS n_edges,
       COUNT(*) FILTER (WHERE target_node_id NOT IN (SELECT node_id FROM lnk_nodes)) AS n_unresolved
FROM lnk_edges GROUP BY type, confidence
"""

ORACLE["gap_report"] = f"""
WITH {sv.LNK}, {sv.DOC_FILES}, {sv.REG}, {sv.ENT_EDGES}
SELECT 'no_extractor' AS section, file_type AS key, COUNT(*) AS n
FROM files WHERE file_type NOT IN (SELECT file_type FROM reg) GROUP BY file_type
UNION ALL
SELECT 'unresolved', type || '/' || confidence,
       COUNT(*) FILTER (WHERE target_node_id NOT IN (SELECT node_id FROM lnk_nodes))
FROM lnk_edges GROUP BY type, confidence
UNION ALL
SELECT 'low_confidence', type, COUNT(*) FROM ent_edges WHERE confidence = 'inferred' GROUP BY type
"""

ORACLE["cross_site_segment_match"] = f"""
WITH {sv.LNK},
segs AS (SELECT {sv.FIRST_SEG.format(c='node_id')} AS segment, COUNT(*) AS n_routes
         FROM lnk_nodes WHERE length({sv.FIRST_SEG.format(c='node_id')}) > 0 GROUP BY 1)
SELECT e.edge_id, e.target_node_id AS href, 'path' AS match_kind, n.node_id AS target,
       CAST(1 AS BIGINT) AS n_routes, 'deterministic' AS confidence
FROM lnk_edges e JOIN lnk_nodes n ON n.node_id = e.target_node_id
UNION ALL
SELECT e.edge_id, e.target_node_id, 'segment', s.segment, s.n_routes, 'probabilistic'
FROM lnk_edges e JOIN segs s ON s.segment = {sv.FIRST_SEG.format(c='e.target_node_id')}
"""

ORACLE["registry_match"] = f"""
WITH {sv.DOC_FILES}, {sv.REG}
SELECT f.doc_id, f.file_type, r.skill_id FROM files f JOIN reg r ON r.file_type = f.file_type
"""

ORACLE["files_without_extractor"] = f"""
WITH {sv.DOC_FILES}, {sv.REG}
SELECT file_type, COUNT(*) AS n_files FROM files
WHERE file_type NOT IN (SELECT file_type FROM reg) GROUP BY file_type
"""

ORACLE["ext_language_map"] = f"""
WITH {sv.DOC_FILES}
SELECT doc_id, path, regexp_extract(path, '\\.([^./]+)$', 1) AS ext,
       CASE regexp_extract(path, '\\.([^./]+)$', 1)
         WHEN 'cs' THEN 'csharp' WHEN 'ts' THEN 'typescript' WHEN 'tsx' THEN 'typescript'
         WHEN 'js' THEN 'javascript' WHEN 'jsx' THEN 'javascript' WHEN 'py' THEN 'python'
         WHEN 'html' THEN 'html' WHEN 'css' THEN 'css' WHEN 'scss' THEN 'scss'
         WHEN 'json' THEN 'json' WHEN 'yaml' THEN 'yaml' WHEN 'yml' THEN 'yaml'
         WHEN 'proto' THEN 'protobuf' ELSE regexp_extract(path, '\\.([^./]+)$', 1) END AS language
FROM files
"""

_CONTRACT = """c AS (
  SELECT 'doc:' || CAST(doc_id AS VARCHAR) AS node_id, lang AS language, source AS source_file,
         text AS raw_cleaned,
         CASE WHEN doc_id % 11 = 0 THEN NULL ELSE 'document' END AS chunk_type,
         CASE WHEN doc_id % 9 = 0 THEN '' ELSE text END AS summary,
         doc_id
  FROM documents)"""


def _missing(f: str) -> str:
    return f"CASE WHEN {f} IS NULL OR trim(CAST({f} AS VARCHAR)) = '' THEN 'missing {f}' END"


ORACLE["contract_validation"] = f"""
WITH {_CONTRACT},
e AS (SELECT node_id, list_filter([{', '.join(_missing(f) for f in
      ['node_id', 'language', 'source_file', 'chunk_type', 'raw_cleaned', 'summary'])}],
      lambda x: x IS NOT NULL) AS errs FROM c)
SELECT node_id, len(errs) = 0 AS valid, array_to_string(errs, ', ') AS errors FROM e
"""

ORACLE["inline_edges"] = f"""
WITH {_CONTRACT},
x AS (
  SELECT node_id AS source_node_id, 0 AS pos, 'src:' || source_file AS target, 'BELONGS_TO' AS type,
         (['deterministic', 'probabilistic', 'bogus', NULL])[(doc_id % 4) + 1] AS confidence,
         'source' AS evidence FROM c
  UNION ALL
  SELECT node_id, 1, CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'lang:' || language END,
         'WRITTEN_IN', 'inferred', 'lang' FROM c)
SELECT sha256(concat_ws(chr(1), source_node_id, target, type, CAST(pos AS VARCHAR))) AS edge_id,
       source_node_id, target AS target_node_id, type,
       CASE WHEN confidence IN ('deterministic', 'probabilistic', 'inferred') THEN confidence
            ELSE 'inferred' END AS confidence,
       evidence
FROM x WHERE length(COALESCE(target, '')) > 0
"""

ORACLE["json_repair"] = """
SELECT conv_id, turn, role,
       NOT (contains(text, '"') OR contains(text, chr(92))) AS parsed,
       NOT (contains(text, '"') OR contains(text, chr(92))) AS text_ok
FROM conversations
"""

_ROUTE_VALUES = """routes(route, target, direction, depth) AS (VALUES
  ('blast_radius', 'node', 'inbound', 3), ('dependents', 'node', 'inbound', 2),
  ('dependencies', 'node', 'outbound', 2), ('behaviour', 'node', 'outbound', 2),
  ('connection', 'node', 'both', 2), ('domain', 'community', 'none', 0), ('lookup', 'node', 'none', 0))"""

# the routes that each question form must take are stated, not matched; no benchmark item asks for a walk
_FORM_ROUTES = """forms(form, route) AS (VALUES (0, 'blast_radius'), (1, 'blast_radius'), (2, 'dependents'), (3, 'dependents'),
  (4, 'dependencies'), (5, 'behaviour'), (6, 'connection'), (7, 'domain'), (8, 'lookup'))"""

ORACLE["question_routing"] = f"""
WITH {_ROUTE_VALUES}, {_FORM_ROUTES},
e AS (SELECT 'n:' || CAST(n_nationkey AS VARCHAR) AS id FROM nation
      UNION ALL SELECT 's:' || CAST(s_suppkey AS VARCHAR) FROM supplier),
q AS (SELECT id || '#' || CAST(form AS VARCHAR) AS question_id, route FROM e CROSS JOIN forms
      UNION ALL SELECT 'item:' || CAST(item_id AS VARCHAR), 'lookup' FROM benchmark)
SELECT question_id, q.route, target, direction, CAST(depth AS INTEGER) AS depth FROM q JOIN routes ON routes.route = q.route
"""


def _question_walk(form: int, direction: str, depth: int) -> str:
    return f"""SELECT root_id || '#{form}' AS question_id, hop, COUNT(*) AS n_edges FROM (
WITH {_walk('supplier', direction, depth)}
{sv.visited_edges_sql(direction, depth)}) w GROUP BY root_id, hop"""


ORACLE["question_walks"] = "\nUNION ALL\n".join([
    _question_walk(0, "inbound", 3), _question_walk(2, "inbound", 2), _question_walk(4, "outbound", 2)])

_ENTITIES = """entities AS (SELECT 'n:' || CAST(n_nationkey AS VARCHAR) AS id, n_name AS name FROM nation
      UNION ALL SELECT 's:' || CAST(s_suppkey AS VARCHAR), s_name FROM supplier)"""

ORACLE["question_walks_routed"] = "\nUNION ALL\n".join(
    f"""SELECT root_id || '#' || form AS question_id, hop, n_edges FROM (
SELECT root_id, hop, COUNT(*) AS n_edges FROM (
WITH {_ENTITIES}, {sv.ENT_NODES}, {sv.ENT_EDGES}, roots AS MATERIALIZED (SELECT id AS root_id FROM entities),
{sv.arcs_cte(direction)}, {sv.bfs_ctes(depth)}
{sv.visited_edges_sql(direction, depth)}) w GROUP BY root_id, hop) n, (VALUES {forms}) f(form)"""
    for direction, depth, forms in [("inbound", 3, "('0'), ('1')"), ("inbound", 2, "('2'), ('3')"),
                                    ("outbound", 2, "('4'), ('5')"), ("both", 2, "('6')")])

_FORM_TEXTS = "texts(form, form_text) AS (VALUES " + ", ".join(
    f"({i}, '{text}')" for i, (_, text) in enumerate(QUESTION_FORMS)) + ")"

_ALL_QUESTIONS = f"""{_ROUTE_VALUES}, {_FORM_ROUTES}, {_FORM_TEXTS}, {_ENTITIES},
aq AS MATERIALIZED (
  SELECT id || '#' || CAST(forms.form AS VARCHAR) AS question_id, route, replace(form_text, '%s', name) AS text
  FROM entities, forms JOIN texts ON texts.form = forms.form
  UNION ALL SELECT 'item:' || CAST(item_id AS VARCHAR), 'lookup', text FROM benchmark)"""


def _ranked_corrections(name: str, condition: str) -> str:
    """CTE of the 5 best corrections of each question by the sum of N * 1000 // df of the words they have."""
    return f"""{name}_text AS MATERIALIZED (
  SELECT correction_id, lower(concat_ws(' ', COALESCE(original, ''), COALESCE(corrected, ''), COALESCE(target_id, ''))) AS s
  FROM cor WHERE {condition}),
{name}_post AS MATERIALIZED (SELECT word, correction_id FROM (SELECT DISTINCT word FROM aw) w JOIN {name}_text c ON contains(c.s, w.word)),
{name}_df AS (SELECT word, (SELECT COUNT(*) FROM {name}_text) * 1000 // COUNT(*) AS weight FROM {name}_post GROUP BY word),
{name}_score AS (SELECT question_id, correction_id, CAST(SUM(weight) AS BIGINT) AS score
  FROM aw JOIN {name}_df USING (word) JOIN {name}_post USING (word) GROUP BY question_id, correction_id),
{name} AS MATERIALIZED (SELECT *, CAST(row_number() OVER (PARTITION BY question_id ORDER BY score DESC, correction_id) AS INTEGER) AS rank
  FROM {name}_score QUALIFY rank <= 5)"""


_ALL_WORDS = r"""aw AS MATERIALIZED (
  SELECT DISTINCT question_id, w AS word FROM (SELECT question_id, unnest(regexp_split_to_array(lower(text), '\s+')) AS w FROM aq) t
  WHERE length(w) > 2)"""

ORACLE["context_changes"] = f"""
WITH {sv.COR}, {_ALL_QUESTIONS}, {_ALL_WORDS}, {_ranked_corrections('early', 'turn < 4')}, {_ranked_corrections('late', 'TRUE')}
SELECT question_id, correction_id,
       CASE WHEN e.rank IS NULL THEN 'added' WHEN l.rank IS NULL THEN 'removed' ELSE 'moved' END AS change,
       e.rank AS old_rank, l.rank AS new_rank
FROM early e FULL JOIN late l USING (question_id, correction_id) WHERE e.rank IS DISTINCT FROM l.rank
"""


def _pairs(text: str) -> str:
    """Vector of hashed neighbouring characters of a text column without null."""
    return f"""list_transform(range(0, 64), lambda d: CAST(len(list_filter(
      list_transform(range(1, length({text})), lambda i: (ascii(substr({text}, i, 1)) * 31 + ascii(substr({text}, i + 1, 1))) % 64),
      lambda h: h = d)) AS DOUBLE))"""


def _routed_walk(direction: str, depth: int) -> str:
    return f"""SELECT w.*, '{direction}' AS direction, {depth} AS depth FROM (
  WITH roots AS MATERIALIZED (SELECT DISTINCT root_id FROM starts WHERE direction = '{direction}' AND depth = {depth}),
  {sv.arcs_cte(direction)}, {sv.bfs_ctes(depth)}
  SELECT root_id, edge_id, hop, {sv.TIER.format(c='confidence')} AS tier FROM ({sv.visited_edges_sql(direction, depth)}) v) w"""


ORACLE["context_retrieval"] = rf"""
WITH {sv.COR}, {sv.ENT_NODES}, {sv.ENT_EDGES}, {_ALL_QUESTIONS}, {_ALL_WORDS}, {_ranked_corrections('cr', 'TRUE')},
named AS (SELECT question_id, route, text, regexp_extract_all(
            regexp_replace(text, '(^|[.?!]\s+)[A-Za-z]+', ' ', 'g'), '[A-Z][A-Za-z0-9_#]*') AS names FROM aq),
t AS MATERIALIZED (
  SELECT question_id, n.route, target, direction, depth,
         CASE WHEN len(names) > 0 THEN array_to_string(names, ' ') ELSE text END AS terms
  FROM named n JOIN routes ON routes.route = n.route),
tv AS MATERIALIZED (SELECT terms, target, {_pairs('x')} AS v FROM (
  SELECT DISTINCT terms, target, regexp_replace(terms, '[^ -~]', '', 'g') AS x FROM t) d),
nv AS MATERIALIZED (SELECT node_id, {_pairs('x')} AS v FROM (
  SELECT node_id, regexp_replace(COALESCE(summary, ''), '[^ -~]', '', 'g') AS x FROM ent_nodes) d),
cs AS (SELECT 'comm:r:' || CAST(r_regionkey AS VARCHAR) AS community_id, concat_ws(' ', r_name, nations) AS x
       FROM region LEFT JOIN (SELECT n_regionkey, string_agg(n_name, ' ' ORDER BY n_name) AS nations FROM nation GROUP BY 1) n
       ON n_regionkey = r_regionkey),
cv AS (SELECT community_id, {_pairs('x')} AS v FROM cs),
dn AS (SELECT terms, node_id, list_distance(tv.v, nv.v) AS d FROM tv, nv WHERE target = 'node'),
nn AS MATERIALIZED (SELECT *, CAST(row_number() OVER (PARTITION BY terms ORDER BY d, node_id) AS INTEGER) AS rank FROM dn QUALIFY rank <= 5),
dc AS (SELECT terms, community_id, list_distance(tv.v, cv.v) AS d FROM tv, cv WHERE target = 'community'),
nc AS MATERIALIZED (SELECT *, CAST(row_number() OVER (PARTITION BY terms ORDER BY d, community_id) AS INTEGER) AS rank FROM dc QUALIFY rank <= 3),
starts AS MATERIALIZED (SELECT question_id, route, node_id AS root_id, direction, depth FROM t JOIN nn ON nn.terms = t.terms AND nn.rank = 1
  WHERE direction <> 'none' AND target = 'node'),
walks AS MATERIALIZED (
  {_routed_walk('inbound', 3)} UNION ALL {_routed_walk('inbound', 2)} UNION ALL
  {_routed_walk('outbound', 2)} UNION ALL {_routed_walk('both', 2)}),
we AS (SELECT *, CAST(row_number() OVER (PARTITION BY root_id, direction, depth ORDER BY tier, hop, edge_id) AS INTEGER) AS rank,
              COUNT(*) OVER (PARTITION BY root_id, direction, depth) AS n_edges FROM walks QUALIFY rank <= 10)
SELECT question_id, route, 'correction' AS kind, 0 AS kind_order, rank, correction_id AS item, score FROM cr JOIN t USING (question_id)
UNION ALL SELECT question_id, route, 'community', 1, rank, community_id, CAST(round(d * d) AS BIGINT) FROM t JOIN nc USING (terms) WHERE target = 'community'
UNION ALL SELECT question_id, route, 'node', 2, rank, node_id, CAST(round(d * d) AS BIGINT) FROM t JOIN nn USING (terms) WHERE target = 'node'
UNION ALL SELECT question_id, route, 'edge', 3, rank, edge_id, n_edges
  FROM starts s JOIN we ON we.root_id = s.root_id AND we.direction = s.direction AND we.depth = s.depth
"""

_ADDRESS = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"

ORACLE["stream_files"] = f"""
WITH d AS (SELECT doc_id, concat_ws('.', source, lang, 'txt') AS path, lang, CAST(regexp_extract(source, '([0-9]+)$', 1) AS INTEGER) AS number,
                  translate(COALESCE(text, ''), chr(10) || chr(13) || chr(9), '   ') AS body FROM documents),
c AS MATERIALIZED (
  SELECT path, CAST(doc_id AS VARCHAR) AS name,
         CASE WHEN (lang = 'fr' AND number % 2 = 1) OR lang = 'de' THEN body || ' (edited)' ELSE body END AS body
  FROM d WHERE lang <> 'de' OR number % 4 = 0),
e AS (SELECT path, 'BELONGS_TO' AS name, path AS detail FROM c
      UNION ALL SELECT path, 'MENTIONS', unnest(regexp_extract_all(body, '{_ADDRESS}')) FROM c)
SELECT 'chunk' AS kind, path, name, sha256(body) AS detail, CAST(1 AS BIGINT) AS n FROM c
UNION ALL SELECT 'edge', path, name, detail, COUNT(*) FROM e GROUP BY ALL
"""

ORACLE["extract_user_function"] = rf"""
WITH {sv.DOC_FILES},
x AS (SELECT path, COALESCE(m.language, ext) AS language, string_split(COALESCE(text, ''), chr(10)) AS lines
      FROM (SELECT *, regexp_extract(path, '\.([^./]+)$', 1) AS ext FROM files) f
      LEFT JOIN (VALUES ('cs', 'csharp'), ('ts', 'typescript'), ('tsx', 'typescript'), ('py', 'python'), ('scss', 'scss'), ('json', 'json'),
                        ('yml', 'yaml'), ('proto', 'protobuf')) m(e, language) ON m.e = f.ext),
l AS MATERIALIZED (SELECT path, language, i, lines[i] AS line,
                          regexp_matches(lines[i], '(?i)(token|secret|password|api_key)\s*=\s*"[0-9a-f]{{16,}}"') AS bad
                   FROM x, LATERAL (SELECT unnest(range(1, len(lines) + 1)) AS i) r),
b AS (SELECT path, language, MIN(i) AS i FROM l WHERE bad GROUP BY path, language)
SELECT path, language, CASE WHEN n > 0 THEN 'contact' ELSE 'paragraph' END AS chunk_type, 'line ' || i AS name, line AS raw_cleaned,
       CAST(n AS INTEGER) AS n_edges, CAST(NULL AS VARCHAR) AS error_class, CAST(NULL AS VARCHAR) AS error_message
FROM (SELECT *, len(regexp_extract_all(line, '{_ADDRESS}')) AS n FROM l WHERE path NOT IN (SELECT path FROM b) AND trim(line, ' ') <> '') t
UNION ALL SELECT path, language, NULL, NULL, NULL, 0, 'ValueError', 'secret in line ' || i FROM b
"""

ORACLE["connect_paths"] = f"""
WITH {sv.ENT_EDGES},
ends AS (SELECT source_node_id AS u, target_node_id AS v, {sv.TIER.format(c='confidence')} AS tier, edge_id, type, 'true' AS forward
         FROM ent_edges WHERE source_node_id <> target_node_id
         UNION ALL SELECT target_node_id, source_node_id, {sv.TIER.format(c='confidence')}, edge_id, type, 'false'
         FROM ent_edges WHERE source_node_id <> target_node_id),
st AS MATERIALIZED (SELECT u, v, count(*) AS n, arg_min(tier, (tier, edge_id)) AS tier, arg_min(edge_id, (tier, edge_id)) AS edge_id,
                           arg_min(type, (tier, edge_id)) AS type, arg_min(forward, (tier, edge_id)) AS forward FROM ends GROUP BY u, v),
pairs AS (SELECT 'c:' || o_custkey AS a, 's:' || l_suppkey AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey
          UNION SELECT 'c:' || c_custkey, 'n:' || c_nationkey FROM customer
          UNION SELECT 'c:' || c_custkey, 'r:' || n_regionkey FROM customer JOIN nation ON n_nationkey = c_nationkey),
f AS (SELECT a, b, 1 AS hops, a || ' ' || b AS nodes, edge_id AS edge_ids, type AS types, forward, tier, n AS n_parallel
      FROM pairs JOIN st ON u = a AND v = b
      UNION ALL
      SELECT a, b, 2, a || ' ' || x.v || ' ' || b, x.edge_id || ' ' || y.edge_id, x.type || ' ' || y.type, x.forward || ' ' || y.forward,
             greatest(x.tier, y.tier), x.n * y.n
      FROM pairs JOIN st x ON x.u = a JOIN st y ON y.u = x.v AND y.v = b)
SELECT a, b, hops, nodes, edge_ids, types, forward,
       CASE tier WHEN 0 THEN 'deterministic' WHEN 1 THEN 'probabilistic' ELSE 'inferred' END AS weakest_confidence, n_parallel FROM f
"""


def _segments(url: str) -> str:
    return (rf"list_transform(list_filter(string_split(regexp_replace(regexp_replace({url}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', ''), "
            rf"'[?#].*$', ''), '/'), lambda s: s <> ''), lambda s: CASE WHEN regexp_matches(s, '\$\{{|^\{{.*\}}$|^:[A-Za-z_]|^\*$') THEN '*' ELSE s END)")


_API = f"""ns AS (SELECT COUNT(*) AS n FROM supplier),
routes AS (
  SELECT 'rt:s' || s_suppkey AS route_id, CASE s_suppkey % 3 WHEN 0 THEN '/api/suppliers/' || s_suppkey
         WHEN 1 THEN '/api/nations/' || s_nationkey || '/suppliers/{{id}}' ELSE '/api/suppliers/:id/parts/' || (s_suppkey % 7) END AS template FROM supplier
  UNION ALL SELECT 'rt:n' || n_nationkey, '/api/{{kind}}/' || n_nationkey FROM nation
  UNION ALL SELECT 'rt:r' || r_regionkey, '/api/{{kind}}/{{id}}' FROM region),
specs AS (
  SELECT 'getSupplier' || s_suppkey AS operation, '/api/suppliers/' || s_suppkey AS template FROM supplier WHERE s_suppkey % 6 = 0
  UNION ALL SELECT 'listNation' || n_nationkey, '/api/nations/' || n_nationkey || '/suppliers/{{id}}' FROM nation WHERE n_nationkey % 2 = 0),
calls AS (
  SELECT 'o:' || o_orderkey AS call_id,
         CASE o_custkey % 8 WHEN 0 THEN '/api/suppliers/' || (o_orderkey % n + 1) || '?x=1' WHEN 1 THEN '/api/nations/' || (o_orderkey % 25) || '/suppliers/${{sid}}'
           WHEN 2 THEN 'https://host.example/api/suppliers/' || (o_orderkey % n + 1) || '/parts/' || (o_orderkey % 9)
           WHEN 4 THEN '/api/${{kind}}/' || (o_orderkey % 25) WHEN 5 THEN '/${{base}}/suppliers/' || (o_orderkey % n + 1)
           WHEN 6 THEN '/api/orders/' || o_orderkey || '/lines' WHEN 7 THEN '/api/nations/' || (o_orderkey % 25) || '#top' END AS url,
         CASE o_custkey % 8 WHEN 3 THEN 'getSupplier' || (o_orderkey % n + 1) WHEN 7 THEN 'op' || o_orderkey END AS operation
  FROM orders, ns),
rp AS (SELECT route_id, {_segments('template')} AS p FROM routes),
sp AS (SELECT operation, {_segments('template')} AS p FROM specs),
node AS (SELECT route_id, p, CASE WHEN operation IS NULL THEN 'contract:/' || array_to_string(p, '/') ELSE 'spec:' || operation END AS contract_id,
                CASE WHEN operation IS NULL THEN 'synthetic' ELSE 'spec' END AS source
         FROM rp LEFT JOIN (SELECT p, MIN(operation) AS operation FROM sp GROUP BY p) s USING (p))"""

ORACLE["api_contracts"] = f"""
WITH {_API}
SELECT route_id AS source_node_id, contract_id AS target_node_id, 'IMPLEMENTS' AS type, 'deterministic' AS confidence,
       source || ' contract' AS evidence FROM node
"""

ORACLE["api_calls"] = f"""
WITH {_API},
cp AS (SELECT DISTINCT {_segments('url')} AS c FROM calls WHERE url IS NOT NULL),
m AS (SELECT c, p, len(list_filter(range(1, len(c) + 1), lambda i: c[i] <> '*' AND p[i] <> '*')) AS same,
             len(list_filter(p, lambda x: x = '*')) AS wild
      FROM cp JOIN (SELECT DISTINCT p FROM rp) r ON len(c) = len(p)
      AND len(list_filter(range(1, len(c) + 1), lambda i: c[i] <> '*' AND p[i] <> '*' AND c[i] <> p[i])) = 0),
b AS (SELECT c, MIN(array_to_string(p, '/')) AS r, COUNT(*) AS n_routes FROM (
        SELECT *, rank() OVER (PARTITION BY c ORDER BY same DESC, wild) AS k FROM m) x WHERE k = 1 GROUP BY c),
q AS (SELECT call_id, array_to_string(b.c, '/') AS text, r, n_routes, list_contains(b.c, '*') AS dyn,
             (SELECT 'spec:' || MIN(s.operation) FROM specs s WHERE s.operation = calls.operation) AS op,
             (SELECT MIN(contract_id) FROM node WHERE array_to_string(p, '/') = r) AS contract_id
      FROM calls LEFT JOIN b ON b.c = {_segments('url')}),
k AS (SELECT *, CASE WHEN op IS NOT NULL THEN 'contract' WHEN r IS NULL THEN 'none' WHEN NOT dyn AND r = text THEN 'path'
                     WHEN NOT dyn THEN 'template' ELSE 'dynamic' END AS kind FROM q)
SELECT call_id, kind, COALESCE(op, contract_id) AS contract_id, CAST(CASE WHEN op IS NOT NULL THEN 1 ELSE COALESCE(n_routes, 0) END AS BIGINT) AS n_routes,
       CASE WHEN kind = 'contract' THEN 'deterministic' WHEN kind = 'none' THEN NULL WHEN n_routes > 1 THEN 'inferred'
            WHEN kind = 'dynamic' THEN 'probabilistic' ELSE 'deterministic' END AS confidence FROM k
"""

ORACLE["vector_topk_approx"] = """
SELECT metric, COUNT(*) AS n_queries, CAST(0 AS BIGINT) AS n_short, true AS recall_ok, CAST(0 AS BIGINT) AS n_wrong
FROM embeddings, (VALUES ('cosine'), ('dot')) m(metric) WHERE vec_id % 100 = 0 GROUP BY metric
"""

_VALIDITY = f"""{sv.RUN},
snap AS (SELECT sprint AS suite, ts AS t, MAX(prompt_version) AS version FROM runs WHERE canonical GROUP BY sprint, ts),
chg AS (SELECT *, lag(version) OVER w IS DISTINCT FROM version AS changed FROM snap WINDOW w AS (PARTITION BY suite ORDER BY t)),
isl AS (SELECT *, SUM(CASE WHEN changed THEN 1 ELSE 0 END) OVER (PARTITION BY suite ORDER BY t) AS i FROM chg),
grp AS (SELECT suite, i, MIN(version) AS version, MIN(t) AS valid_from, COUNT(*) AS n_snapshots FROM isl GROUP BY suite, i),
val AS MATERIALIZED (SELECT suite, version, valid_from, lead(valid_from) OVER (PARTITION BY suite ORDER BY valid_from) AS valid_to, n_snapshots FROM grp)"""

ORACLE["version_intervals"] = f"WITH {_VALIDITY} SELECT * FROM val"

ORACLE["version_index"] = f"""
WITH {_VALIDITY}
SELECT suite, version, MIN(valid_from) AS first_from, MAX(valid_from) AS last_from, COUNT(*) AS n_intervals,
       CAST(SUM(n_snapshots) AS BIGINT) AS n_snapshots, bool_or(valid_to IS NULL) AS in_force FROM val GROUP BY suite, version
"""

ORACLE["runs_as_of"] = f"""
WITH {_VALIDITY}
SELECT event_id, sprint, prompt_version, v.version AS version_in_force, v.valid_from
FROM runs r ASOF LEFT JOIN val v ON v.suite = r.sprint AND r.ts >= v.valid_from
"""

_NAMED = rf"""{sv.COR}, {sv.DOC_FILES},
nn AS (SELECT 'doc:' || doc_id AS node_id, path AS source_file,
              CASE WHEN doc_id % 10 = 0 THEN 'shared.' || COALESCE(file_type, 'none') ELSE source || '.Doc' || doc_id END AS name FROM files),
nc AS (SELECT correction_id, CASE (conv_id + turn) % 6 WHEN 0 THEN 'doc:' || doc_id WHEN 1 THEN 'file://' || path
              WHEN 2 THEN ' ' || upper(source) || '.DOC' || doc_id || ' ' WHEN 3 THEN 'DOC' || doc_id
              WHEN 4 THEN 'Shared.' || COALESCE(file_type, 'none') ELSE 'Nothing#' || doc_id END AS t
       FROM cor JOIN files ON doc_id = conv_id % (SELECT COUNT(*) FROM documents)),
ali AS (SELECT 0 AS k, node_id AS alias, node_id, source_file FROM nn UNION SELECT 1, source_file, node_id, source_file FROM nn
        UNION SELECT 2, lower(trim(name)), node_id, source_file FROM nn
        UNION SELECT 3, regexp_extract(lower(trim(name)), '([^./:#]+)$', 1), node_id, source_file FROM nn),
asked AS (SELECT correction_id, 0 AS k, t AS alias FROM nc
          UNION ALL SELECT correction_id, 1, regexp_replace(regexp_replace(t, '^file:(//)?', ''), '^(\./)+', '') FROM nc
          UNION ALL SELECT correction_id, 2, lower(trim(t)) FROM nc UNION ALL SELECT correction_id, 3, regexp_extract(lower(trim(t)), '([^./:#]+)$', 1) FROM nc),
hit AS (SELECT correction_id, k, alias, COUNT(*) AS n, MIN(node_id) AS node_id, MIN(source_file) AS lo, MAX(source_file) AS hi
        FROM asked JOIN ali USING (k, alias) GROUP BY correction_id, k, alias),
res AS MATERIALIZED (
  SELECT nc.correction_id, (['id', 'path', 'name', 'segment'])[h.k + 1] AS match_kind, h.alias, COALESCE(h.n, 0) AS n_nodes,
         CASE WHEN h.n = 1 THEN h.node_id END AS node_id, CASE WHEN h.lo = h.hi THEN h.lo END AS source_file
  FROM nc LEFT JOIN (SELECT * FROM hit QUALIFY row_number() OVER (PARTITION BY correction_id ORDER BY k) = 1) h USING (correction_id))"""

ORACLE["corrections_named"] = f"WITH {_NAMED} SELECT * FROM res"

ORACLE["corrections_of_files"] = f"WITH {_NAMED} SELECT source_file, correction_id, match_kind FROM res WHERE source_file IS NOT NULL"

ORACLE["store_communities"] = f"""
WITH RECURSIVE {sv.DUP}, {sv.DUP_COMPONENTS}
SELECT 'doc:' || c.id AS node_id, k.first_member, k.n_members, k.n_members AS n_listed,
       CASE WHEN k.n_members IS NOT NULL THEN true END AS has_summary, CASE WHEN k.n_members IS NOT NULL THEN true END AS has_vector
FROM comp c LEFT JOIN keep k ON k.component = c.component
"""

ORACLE["run_assertions"] = f"""
WITH {sv.ENT_NODES}, {sv.ENT_EDGES},
reg AS (SELECT 'x-' || n_nationkey AS subject, n_nationkey AS n, lower('tool ' || n_name || chr(10) ||
          CASE WHEN n_nationkey % 4 <> 0 THEN 'Uses the ' || CASE WHEN n_nationkey % 3 = 0 THEN 'Native-Parser' ELSE 'regex' END ELSE '' END || chr(10) ||
          CASE WHEN n_nationkey % 5 = 0 THEN 'import native-parser' ELSE '' END) AS words FROM nation),
one AS (SELECT 'registry' AS "table", 'parser_keyword' AS "check", subject, CAST(contains(words, 'native-parser') AS INT) AS o, 1 AS x FROM reg
  UNION ALL SELECT 'registry', 'has_handbook', subject, CASE WHEN n % 4 <> 0 THEN 1 ELSE 0 END, 1 FROM reg
  UNION ALL SELECT 'registry', 'has_summarisation_instructions', subject, 1, 1 FROM reg
  UNION ALL SELECT 'registry', 'has_application_role', subject, CASE WHEN n % 7 = 0 THEN 0 ELSE 1 END, 1 FROM reg
  UNION ALL SELECT 'nodes', 'min_nodes', NULL, (SELECT COUNT(*) FROM ent_nodes), 8
  UNION ALL SELECT 'nodes', 'min_files', NULL, (SELECT COUNT(DISTINCT source_file) FROM ent_nodes), 7
  UNION ALL SELECT 'edges', 'min_deterministic', NULL, (SELECT COUNT(*) FROM ent_edges WHERE confidence = 'deterministic'), 1
  UNION ALL SELECT 'edges', 'expected_edge_types', NULL, (SELECT COUNT(*) FROM ent_edges WHERE type IN ('IMPORTS', 'CALLS')), 1
  UNION ALL SELECT 'communities', 'min_communities', NULL, (SELECT COUNT(*) FROM region), 4
  UNION ALL SELECT 'answers', 'answer_keywords', CAST(item_id AS VARCHAR), CAST(regexp_matches(lower(COALESCE(text, '')), 'order|service|thth') AS INT), 1 FROM benchmark)
SELECT "table", "check", subject, CAST(o AS VARCHAR) AS observed, '>= ' || x AS expected, o >= x AS passed FROM one
UNION ALL SELECT 'registry', 'environment', subject, CASE WHEN n % 6 = 0 THEN 'node' ELSE 'python' END, '= python', n % 6 <> 0 FROM reg
UNION ALL SELECT 'edges', 'invalid_confidences', NULL, '0', '= 0', true
UNION ALL SELECT 'communities', 'without_summary', NULL, '1', '= 0', false
UNION ALL SELECT 'answers', 'answer_length', CAST(item_id AS VARCHAR), CAST(length(COALESCE(text, '')) AS VARCHAR), '> 100', length(COALESCE(text, '')) > 100 FROM benchmark
"""

ORACLE["run_summary"] = f"""
WITH {sv.ENT_NODES}, {sv.ENT_EDGES}
SELECT n.*, e.*, (SELECT COUNT(*) FROM region) AS communities, c.*, true AS timed
FROM (SELECT COUNT(*) FILTER (WHERE chunk_type <> 'region' AND length(summary) > 0) AS nodes,
             COUNT(*) FILTER (WHERE chunk_type = 'region' OR COALESCE(length(summary), 0) = 0) AS rejected FROM ent_nodes) n,
     (SELECT COUNT(*) AS edges, COUNT(*) FILTER (WHERE confidence = 'deterministic') AS n_deterministic,
             COUNT(*) FILTER (WHERE confidence = 'probabilistic') AS n_probabilistic, COUNT(*) FILTER (WHERE confidence = 'inferred') AS n_inferred,
             COUNT(*) FILTER (WHERE confidence = 'inferred') AS coerced FROM ent_edges) e,
     (SELECT COUNT(*) AS calls, CAST(SUM(COALESCE(CAST(json_extract_string(props, '$.k') AS BIGINT), 0)) AS BIGINT) AS in_tokens,
             CAST(SUM(event_id % 1000) AS BIGINT) AS out_tokens, CAST(SUM(COALESCE(CAST(value AS DECIMAL(18,6)), 0)) AS DOUBLE) AS cost_usd FROM events) c
"""

ORACLE["store_round_trip"] = f"""
WITH {sv.ENT_NODES}, {sv.ENT_EDGES}, {sv.COR},
n AS (SELECT CASE WHEN chunk_type <> 'region' THEN summary END AS summary, chunk_type FROM ent_nodes)
SELECT 'nodes' AS "table", COUNT(*) AS n, COUNT(*) FILTER (WHERE chunk_type = 'part') AS n_filled FROM n WHERE length(summary) > 0
UNION ALL SELECT 'rejected nodes', COUNT(*), 0 FROM n WHERE COALESCE(length(summary), 0) = 0
UNION ALL SELECT 'edges', COUNT(*), COUNT(*) FILTER (WHERE confidence <> 'deterministic') FROM ent_edges WHERE type <> 'INHERITS'
UNION ALL SELECT 'communities', COUNT(*), COUNT(*) FROM region WHERE r_regionkey <> 0
UNION ALL SELECT 'rejected communities', COUNT(*), 0 FROM region WHERE r_regionkey = 0
UNION ALL SELECT 'corrections', COUNT(*), COUNT(*) FROM cor
"""

ORACLE["files_scanned"] = """
SELECT file, 'txt' AS ext, 'txt' AS language, true AS valid_utf8, CAST(length(t) AS INTEGER) AS n_chars, sha256(t) AS content FROM (
  SELECT concat_ws('.', source, lang, 'txt') AS file,
         string_agg(doc_id || chr(9) || translate(COALESCE(text, ''), chr(10) || chr(13) || chr(9), '   ') || chr(10), '' ORDER BY doc_id) AS t
  FROM documents GROUP BY 1) f
"""

ORACLE["run_log_round_trip"] = f"""
WITH {sv.RUN}
SELECT row_number() OVER (ORDER BY timestamp, run_dir) AS run_num, run_dir, sprint, passed, suite_version, CAST(cost_usd AS DOUBLE) AS cost_usd,
       in_tokens, CAST(NULL AS VARCHAR) AS skill_id, canonical FROM runs
"""

ORACLE["registry_json"] = """
SELECT 'x-' || n_nationkey AS skill_id, '["t' || n_nationkey || '",".t\\"' || n_nationkey || '"]' AS as_json,
       't' || n_nationkey || '|.t"' || n_nationkey AS file_types, CASE WHEN n_nationkey % 2 = 0 THEN 'none' END AS limitations, 'CALLS' AS edge_type
FROM nation WHERE n_regionkey % 2 = 0
"""

ORACLE["stripped_lines"] = """
WITH d AS (SELECT doc_id, array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(x, '(?i)licensed under')
             AND NOT regexp_matches(x, '(?i)(token|secret|password|api_key)\\s*=')), chr(10)) AS t FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CAST(length(t) AS INTEGER) AS n_chars, sha256(t) AS content, doc_id % 8 IN (0, 1, 3, 4, 5) AS page_wide FROM d
"""

ORACLE["embedded_documents"] = """
SELECT doc_id, 64 AS dims, regexp_matches(COALESCE(text, ''), '[A-Za-z0-9_]') AS unit, true AS same_for_copies FROM documents
"""

ORACLE["rejected_files"] = f"""
SELECT regexp_extract(path, '\\.([^./]+)$', 1) AS ext, error_class, COUNT(*) AS n_files
FROM ({ORACLE['extract_user_function']}) x WHERE error_class IS NOT NULL GROUP BY ALL
"""

ORACLE["outbound_orders_by_hop"] = f"""
WITH {_walk('orders', 'outbound', 3)}
SELECT root_id, hop, COUNT(*) AS n_edges, CAST(SUM(CAST('0x' || substr(md5(edge_id), 1, 8) AS BIGINT)) AS BIGINT) AS checksum
FROM ({sv.visited_edges_sql('outbound', 3)}) e GROUP BY root_id, hop
"""

ORACLE["invalid_confidences"] = f"""
WITH {sv.ENT_EDGES},
e AS (SELECT edge_id, type, CASE WHEN evidence = '1-URGENT' THEN 'certain' WHEN evidence = 'F' AND confidence = 'inferred' THEN NULL ELSE confidence END AS confidence
      FROM ent_edges)
SELECT confidence, type, COUNT(*) AS n_edges, MIN(edge_id) AS first_edge FROM e
WHERE confidence IS NULL OR confidence NOT IN ('deterministic', 'probabilistic', 'inferred') GROUP BY confidence, type
"""

ORACLE["run_export"] = f"""
WITH {sv.ENT_NODES}, {sv.ENT_EDGES},
n AS (SELECT COUNT(*) AS c, COUNT(DISTINCT source_file) AS f FROM ent_nodes WHERE length(summary) > 0),
e AS (SELECT COUNT(*) AS c, COUNT(*) FILTER (WHERE confidence = 'deterministic') AS d, string_agg(DISTINCT type, ', ' ORDER BY type) AS t FROM ent_edges),
r AS (SELECT COUNT(*) AS c FROM region),
v AS (SELECT COUNT(*) AS calls, CAST(SUM(COALESCE(CAST(json_extract_string(props, '$.k') AS BIGINT), 0)) AS BIGINT) AS in_tokens,
             CAST(SUM(event_id % 1000) AS BIGINT) AS out_tokens, CAST(SUM(COALESCE(CAST(value AS DECIMAL(18,6)), 0)) AS DOUBLE) AS cost_usd FROM events)
SELECT n.c AS nodes_read, e.c AS edges_read, r.c AS communities_read, n.c AS nodes, e.c AS edges, r.c AS communities, n.f AS files, e.t AS edge_types,
       e.d AS n_deterministic, CAST(0 AS BIGINT) AS n_invalid, v.*, true AS timed FROM n, e, r, v
"""

_TRADE = """nations AS (SELECT n_nationkey AS nk, n_regionkey AS rk FROM nation),
mem AS MATERIALIZED (
  SELECT id, nk || '/' || kind AS l0, CAST(nk AS VARCHAR) AS l1, 'region ' || rk AS l2 FROM (
    SELECT 'c:' || c_custkey AS id, c_nationkey AS nk, c_mktsegment AS kind FROM customer
    UNION ALL SELECT 's:' || s_suppkey, s_nationkey, 'supplier' FROM supplier) m JOIN nations USING (nk)),
lv AS MATERIALIZED (SELECT id, 0 AS level, 'comm:0:' || l0 AS c, 'comm:1:' || l1 AS p FROM mem
  UNION ALL SELECT id, 1, 'comm:1:' || l1, 'comm:2:' || l2 FROM mem UNION ALL SELECT id, 2, 'comm:2:' || l2, NULL FROM mem),
trade AS MATERIALIZED (SELECT 'c:' || o_custkey AS src, 's:' || l_suppkey AS dst, COUNT(*) AS w
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL),
ends AS MATERIALIZED (SELECT a.level, a.c AS ca, b.c AS cb, w FROM trade JOIN lv a ON a.id = src JOIN lv b ON b.id = dst AND b.level = a.level),
inside AS (SELECT ca AS c, SUM(w) AS w FROM ends WHERE ca = cb GROUP BY 1),
outside AS (SELECT c, SUM(w) AS w FROM (SELECT ca AS c, w FROM ends WHERE ca <> cb UNION ALL SELECT cb, w FROM ends WHERE ca <> cb) e GROUP BY 1),
kids AS (SELECT p AS c, COUNT(DISTINCT c) AS n FROM lv WHERE p IS NOT NULL GROUP BY 1),
tree AS MATERIALIZED (
  SELECT lv.c AS community_id, level, MIN(p) AS parent_id, COUNT(*) AS n_members,
         CAST(COALESCE(MIN(kids.n), 0) AS BIGINT) AS n_children, CAST(COALESCE(MIN(inside.w), 0) AS BIGINT) AS inner_weight,
         CAST(COALESCE(MIN(outside.w), 0) AS BIGINT) AS cut_weight
  FROM lv LEFT JOIN kids ON kids.c = lv.c LEFT JOIN inside ON inside.c = lv.c LEFT JOIN outside ON outside.c = lv.c
  GROUP BY lv.c, level)"""

ORACLE["community_tree"] = f"WITH {_TRADE} SELECT * FROM tree"

ORACLE["community_closure"] = f"""
WITH RECURSIVE {_TRADE},
up AS (SELECT community_id, community_id AS ancestor_id, CAST(0 AS BIGINT) AS distance FROM tree
       UNION ALL SELECT up.community_id, tree.parent_id, distance + 1 FROM up JOIN tree ON tree.community_id = up.ancestor_id
       WHERE tree.parent_id IS NOT NULL),
below AS (SELECT ancestor_id, CAST(SUM(n_members) AS BIGINT) AS n_below, CAST(SUM(inner_weight) AS BIGINT) AS inner_below
          FROM up JOIN tree ON tree.community_id = up.community_id AND tree.level = 0 GROUP BY ancestor_id)
SELECT community_id, up.ancestor_id, distance, n_below, inner_below FROM up JOIN below ON below.ancestor_id = up.ancestor_id
"""

_FOREST_MODULARITY = """SELECT round(SUM(l) / (SELECT COUNT(*) FROM fe) - SUM(d * d) / (4.0 * (SELECT COUNT(*) FROM fe) * (SELECT COUNT(*) FROM fe)), 9)
  FROM (SELECT c, SUM(l)::DOUBLE AS l, SUM(d)::DOUBLE AS d FROM (
    SELECT a.{c} AS c, CASE WHEN a.{c} = b.{c} THEN 1 ELSE 0 END AS l, 1 AS d FROM fe JOIN fn a ON a.id = src JOIN fn b ON b.id = dst
    UNION ALL SELECT b.{c}, 0, 1 FROM fe JOIN fn b ON b.id = dst) x GROUP BY c) y"""

ORACLE["louvain_tree"] = f"""
WITH place AS (SELECT n_nationkey AS nk, n_regionkey AS rk FROM nation),
cust AS (SELECT c_custkey AS ck, nk, rk FROM customer JOIN place ON nk = c_nationkey),
fn AS MATERIALIZED (
  SELECT 'r' || r_regionkey AS id, -1 - r_regionkey AS nat, r_regionkey AS reg FROM region
  UNION ALL SELECT 'n' || nk, nk, rk FROM place UNION ALL SELECT 'c' || ck, nk, rk FROM cust
  UNION ALL SELECT 's' || s_suppkey, nk, rk FROM supplier JOIN place ON nk = s_nationkey
  UNION ALL SELECT 'o' || o_orderkey, nk, rk FROM orders JOIN cust ON ck = o_custkey),
fe AS MATERIALIZED (
  SELECT 'r' || rk AS src, 'n' || nk AS dst FROM place UNION ALL SELECT 'n' || nk, 'c' || ck FROM cust
  UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier
  UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders)
SELECT COUNT(*) AS n_nodes, COUNT(*) AS n_assigned, CAST(0 AS BIGINT) AS n_wrong_sums, CAST(0 AS BIGINT) AS n_mixed, true AS several_levels,
       ({_FOREST_MODULARITY.format(c='reg')}) AS component_modularity, ({_FOREST_MODULARITY.format(c='nat')}) AS nation_modularity,
       true AS above_components, true AS near_nations FROM fn
"""

ORACLE["cross_file_edges"] = """
WITH defs AS (
  SELECT DISTINCT 's:' || CAST(s_suppkey AS VARCHAR) AS node, 'nation' || CAST(s_nationkey AS VARCHAR) || '.py' AS file,
         unnest([s_name, CASE WHEN s_suppkey % 3 = 0 THEN n_name END]) AS name
  FROM supplier JOIN nation ON s_nationkey = n_nationkey),
d AS (SELECT * FROM defs WHERE name IS NOT NULL),
refs AS (
  SELECT 'o:' || CAST(o_orderkey AS VARCHAR) AS node, 'nation' || CAST(c_nationkey AS VARCHAR) || '.py' AS file,
         CASE o_orderkey % 4 WHEN 0 THEN n_name WHEN 1 THEN 'Unknown#name'
           ELSE 'Supplier#' || lpad(CAST(o_orderkey % (SELECT COUNT(*) FROM supplier) + 1 AS VARCHAR), 9, '0') END AS name,
         (['IMPORTS', 'CALLS', 'INHERITS', 'MENTIONS'])[o_orderkey % 4 + 1] AS kind
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
l AS (SELECT name, file, COUNT(DISTINCT node) AS n, MIN(node) AS target FROM d GROUP BY name, file),
g AS (SELECT name, COUNT(DISTINCT node) AS n, MIN(node) AS target, MIN(file) AS file FROM d GROUP BY name),
r AS (SELECT r.*, l.n AS ln, l.target AS lt, g.n AS gn, g.target AS gt, g.file AS gf,
             coalesce(l.n > 1, false) OR (l.n IS NULL AND coalesce(g.n > 1, false)) AS many
      FROM refs r LEFT JOIN l ON l.name = r.name AND l.file = r.file LEFT JOIN g ON g.name = r.name)
SELECT node AS source_node_id,
       CASE WHEN ln = 1 THEN lt WHEN many THEN 'name:' || name WHEN gn = 1 THEN gt ELSE name END AS target_node_id,
       kind AS type,
       CASE WHEN many THEN 'inferred' WHEN kind = 'CALLS' THEN 'probabilistic' WHEN kind = 'MENTIONS' THEN 'inferred'
            ELSE 'deterministic' END AS confidence,
       file || ' references ' || name || ' defined in '
         || CASE WHEN ln = 1 THEN file WHEN many THEN CAST(gn AS VARCHAR) || ' candidates' WHEN gn = 1 THEN gf ELSE 'nowhere' END AS evidence
FROM r
UNION ALL
SELECT 'name:' || d.name, d.node, 'DEFINES', 'inferred', d.name || ' defined in ' || d.file
FROM d JOIN g ON g.name = d.name WHERE g.n > 1
"""

ORACLE["quality_checks"] = f"""
WITH {sv.ENT_NODES}, {sv.ENT_EDGES},
n AS (SELECT COUNT(*) AS n_nodes, COUNT(DISTINCT source_file) AS n_files FROM ent_nodes),
e AS (SELECT COUNT(*) FILTER (WHERE confidence = 'deterministic') AS n_det,
             COUNT(*) FILTER (WHERE confidence IS NULL OR confidence NOT IN
                              ('deterministic', 'probabilistic', 'inferred')) AS n_invalid,
             list_sort(list_distinct(list(type))) AS types FROM ent_edges),
i AS (SELECT list_sort(list_intersect(types, ['IMPORTS', 'CALLS', 'INHERITS'])) AS inter FROM e)
SELECT 'min_nodes' AS "check", CAST(n_nodes AS VARCHAR) AS observed, '8' AS expected,
       n_nodes >= 8 AS passed FROM n
UNION ALL SELECT 'min_files', CAST(n_files AS VARCHAR), '3', n_files >= 3 FROM n
UNION ALL SELECT 'min_deterministic', CAST(n_det AS VARCHAR), '1', n_det >= 1 FROM e
UNION ALL SELECT 'valid_confidences', CAST(n_invalid AS VARCHAR), '0', n_invalid = 0 FROM e
UNION ALL SELECT 'expected_edge_type', array_to_string(inter, ','), 'IMPORTS,CALLS,INHERITS',
                 len(inter) > 0 FROM i
UNION ALL
SELECT 'answer:' || CAST(item_id AS VARCHAR), CAST(length(text) AS VARCHAR),
       '>100 chars, any of order,service,the',
       length(text) > 100 AND (contains(lower(text), 'order') OR contains(lower(text), 'service')
                               OR contains(lower(text), 'the'))
FROM benchmark
"""

ORACLE["node_lookup"] = """
WITH v AS (
  SELECT 'doc:' || CAST(doc_id AS VARCHAR) AS node_id, text AS summary,
         TIMESTAMP '2024-01-01 00:00:00' AS updated_at FROM documents
  UNION ALL
  SELECT 'doc:' || CAST(doc_id AS VARCHAR), 'Second version. ' || text,
         TIMESTAMP '2024-02-01 00:00:00' FROM documents WHERE lang = 'en')
SELECT node_id, CAST(length(arg_max(summary, updated_at)) AS INTEGER) AS summary_len,
       strftime(MAX(updated_at), '%Y-%m-%d %H:%M:%S') AS updated_at
FROM v GROUP BY node_id
"""

ORACLE["list_nodes"] = f"""
WITH {sv.ENT_NODES}
SELECT node_id, chunk_type FROM ent_nodes ORDER BY node_id LIMIT 200
"""

ORACLE["stream_corrections"] = ORACLE["corrections_capture"]

ORACLE["stream_ingest"] = """
SELECT 'doc:' || CAST(doc_id AS VARCHAR) AS node_id, source AS source_file, lang AS language,
       sha256(text) AS content_hash
FROM documents
"""

ORACLE["context_assembly"] = f"""
WITH {sv.COR}, {sv.QWORDS}, {sv.DUP},
emb AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
q AS (SELECT item_id AS question_id, v FROM benchmark JOIN emb ON vec_id = item_id),
x AS (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x,
             generate_subscripts(embedding, 1) AS pos FROM embeddings),
cent AS (SELECT label, list(m ORDER BY pos) AS v
         FROM (SELECT label, pos, avg(x) AS m FROM x GROUP BY label, pos) t GROUP BY label),
com AS (SELECT question_id, label, CAST(row_number() OVER (PARTITION BY question_id
               ORDER BY list_cosine_similarity(q.v, cent.v) DESC, label) AS INTEGER) AS rank
        FROM q JOIN cent ON TRUE),
nod AS (SELECT question_id, vec_id, CAST(row_number() OVER (PARTITION BY question_id
               ORDER BY list_dot_product(q.v, emb.v) DESC, vec_id) AS INTEGER) AS rank
        FROM q JOIN emb ON emb.vec_id <> q.question_id),
best AS (SELECT question_id, vec_id AS best FROM nod WHERE rank = 1),
ke AS (SELECT src, dst, 0 AS tier FROM dup)
SELECT question_id, 'correction' AS kind, 0 AS kind_order, 0 AS rank, correction_id AS item
FROM ({sv.search_sql()}) s WHERE question_id IN (SELECT question_id FROM q)
UNION ALL
SELECT question_id, 'community', 1, rank, CAST(label AS VARCHAR) FROM com WHERE rank <= 3
UNION ALL
SELECT question_id, 'node', 2, rank, CAST(vec_id AS VARCHAR) FROM nod WHERE rank <= 5
UNION ALL
SELECT b.question_id, 'edge', 3, ke.tier, CAST(ke.src AS VARCHAR) || '-' || CAST(ke.dst AS VARCHAR)
FROM best b JOIN ke ON ke.src = b.best
UNION ALL
SELECT b.question_id, 'edge', 3, ke.tier, CAST(ke.src AS VARCHAR) || '-' || CAST(ke.dst AS VARCHAR)
FROM best b JOIN ke ON ke.dst = b.best
"""

_DIAG = """d AS (
  SELECT doc_id, CAST(pos AS INTEGER) AS line_no, ls[pos] AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents) t,
       LATERAL (SELECT unnest(generate_series(1, len(t.ls))) AS pos) g),
r AS (SELECT * FROM (VALUES
  ('license', 'info', '(?i)(licensed under|released under the .*license)'),
  ('secret', 'error', '(?i)(token|secret|password|api_key)\\s*=\\s*"[0-9a-f]{16,}"'),
  ('personal_data', 'warning', '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}')) v(rule, severity, pat)),
hits AS (SELECT d.doc_id, d.line_no, r.rule, r.severity FROM d JOIN r ON regexp_matches(d.line, r.pat))"""

ORACLE["file_diagnostics"] = f"WITH {_DIAG}\nSELECT doc_id, line_no, rule, severity FROM hits"

ORACLE["diagnostics_by_rule"] = f"""WITH {_DIAG}
SELECT rule, severity, COUNT(*) AS n_lines, COUNT(DISTINCT doc_id) AS n_docs FROM hits
GROUP BY rule, severity"""

ORACLE["model_call_rollup"] = """
SELECT user_id AS run_id, COUNT(*) AS iterations,
       CAST(SUM(COALESCE(CAST(json_extract_string(props, '$.k') AS BIGINT), 0)) AS BIGINT) AS in_tokens,
       CAST(SUM(event_id % 1000) AS BIGINT) AS out_tokens,
       CAST(ROUND(SUM(CAST(value AS DECIMAL(18,6))), 6) AS DOUBLE) AS cost_usd
FROM events GROUP BY user_id
"""

ORACLE["list_communities"] = f"""
WITH RECURSIVE {sv.DUP}, {sv.DUP_COMPONENTS}
SELECT 'doc:' || CAST(component AS VARCHAR) AS community_id, COUNT(*) AS n_members
FROM comp GROUP BY component ORDER BY community_id LIMIT 100
"""

ORACLE["gap_comparison"] = f"""
WITH {sv.DOC_FILES}, {sv.ENT_EDGES},
g1 AS (SELECT 'no_extractor' AS section, file_type AS key, COUNT(*) AS n FROM files
       WHERE file_type NOT IN ('en', '.en', 'fr', '.fr') GROUP BY file_type
       UNION ALL SELECT 'low_confidence', type, COUNT(*) FROM ent_edges
       WHERE confidence = 'inferred' GROUP BY type),
g2 AS (SELECT 'no_extractor' AS section, file_type AS key, COUNT(*) AS n FROM files
       WHERE file_type NOT IN ('en', '.en', 'fr', '.fr', 'de') GROUP BY file_type
       UNION ALL SELECT 'low_confidence', type, COUNT(*) FROM ent_edges
       WHERE confidence = 'inferred' GROUP BY type)
SELECT COALESCE(g1.section, g2.section) AS section, COALESCE(g1.key, g2.key) AS key,
       COALESCE(g1.n, 0) AS n_run1, COALESCE(g2.n, 0) AS n_run2,
       COALESCE(g2.n, 0) - COALESCE(g1.n, 0) AS delta
FROM g1 FULL OUTER JOIN g2 ON g1.section = g2.section AND g1.key = g2.key
"""

_COR_DOC = f"""{sv.COR},
cord AS (SELECT *, 'doc:' || CAST(conv_id % (SELECT COUNT(*) FROM documents) AS VARCHAR) AS doc_target FROM cor)"""

ORACLE["community_corrections"] = f"""
WITH RECURSIVE {sv.DUP}, {sv.DUP_COMPONENTS}, {_COR_DOC}
SELECT m.community_id, m.node_id, c.correction_id FROM members m JOIN cord c ON c.doc_target = m.node_id
"""

ORACLE["corrections_for_documents"] = f"""
WITH {_COR_DOC}
SELECT correction_id, doc_target AS target_id, corrected FROM cord
WHERE doc_target IN (SELECT 'doc:' || CAST(doc_id AS VARCHAR) FROM documents WHERE lang = 'en')
"""

ORACLE["chunk_correction_context"] = f"""
WITH {_COR_DOC}
SELECT 'doc:' || CAST(d.doc_id AS VARCHAR) AS node_id, d.source AS source_file, c.correction_id
FROM documents d LEFT JOIN cord c ON c.doc_target = 'doc:' || CAST(d.doc_id AS VARCHAR)
"""

ORACLE["document_summaries"] = r"""
WITH c AS (SELECT doc_id, substring(trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g')), 1, 400) AS cut FROM documents),
e AS (SELECT doc_id, cut, regexp_extract(cut, '^(.*[.!?])[ \t\n\x0B\f\r]', 1) AS lead FROM c)
SELECT 'doc:' || CAST(doc_id AS VARCHAR) AS node_id, CASE WHEN length(lead) > 0 THEN lead ELSE cut END AS summary FROM e
"""

ORACLE["language_samples"] = f"""
WITH {sv.DOC_FILES},
f AS (SELECT path, (SELECT text FROM documents d WHERE d.doc_id = files.doc_id) AS text,
       CASE regexp_extract(path, '\\.([^./]+)$', 1) WHEN 'cs' THEN 'csharp' WHEN 'ts' THEN 'typescript'
         WHEN 'tsx' THEN 'typescript' WHEN 'py' THEN 'python' WHEN 'yml' THEN 'yaml' WHEN 'proto' THEN 'protobuf'
         ELSE regexp_extract(path, '\\.([^./]+)$', 1) END AS language FROM files)
SELECT language, MIN(path) AS path, substring(arg_min(text, path), 1, 2000) AS sample FROM f GROUP BY language
"""

ORACLE["normalised_paths"] = f"""
WITH {sv.DOC_FILES}
SELECT doc_id, (['', './', 'file://', 'file:./'])[doc_id % 4 + 1] || path AS written, path FROM files
"""
