"""SQL text of the fixture views and unrolled graph walks for the DuckDB oracle.

The oracle is written independently of the DataFrame code in
``graphloom.sources.fixtures`` / ``graphloom.operators``: the same views and
the same contracts, stated as plain SQL over the parquet tables.
"""

from __future__ import annotations


def _id(prefix: str, col: str) -> str:
    return f"'{prefix}' || CAST({col} AS VARCHAR)"


ENT_NODES = f"""ent_nodes AS MATERIALIZED (
  SELECT {_id('r:', 'r_regionkey')} AS node_id, 'region' AS chunk_type, 'region' AS source_file, r_name AS summary FROM region
  UNION ALL SELECT {_id('n:', 'n_nationkey')}, 'nation', 'nation', n_name FROM nation
  UNION ALL SELECT {_id('c:', 'c_custkey')}, 'customer', 'customer', c_name FROM customer
  UNION ALL SELECT {_id('s:', 's_suppkey')}, 'supplier', 'supplier', s_name FROM supplier
  UNION ALL SELECT {_id('p:', 'p_partkey')}, 'part', 'part', p_name FROM part
  UNION ALL SELECT {_id('o:', 'o_orderkey')}, 'order', 'orders', o_orderpriority FROM orders
)"""

_ROWKEY = ("CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_partkey AS VARCHAR) || '-' || "
           "CAST(l_suppkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR)")
_LINE_CONF = ("CASE l_returnflag WHEN 'N' THEN 'deterministic' WHEN 'R' THEN 'probabilistic' "
              "ELSE 'inferred' END")

ENT_EDGES = f"""ent_edges AS MATERIALIZED (
  SELECT {_id('nr:', 'n_nationkey')} AS edge_id, {_id('n:', 'n_nationkey')} AS source_node_id,
         {_id('r:', 'n_regionkey')} AS target_node_id, 'INHERITS' AS type,
         'deterministic' AS confidence, 'fk' AS evidence FROM nation
  UNION ALL SELECT {_id('cn:', 'c_custkey')}, {_id('c:', 'c_custkey')}, {_id('n:', 'c_nationkey')},
         'IMPLEMENTS', 'deterministic', c_mktsegment FROM customer
  UNION ALL SELECT {_id('sn:', 's_suppkey')}, {_id('s:', 's_suppkey')}, {_id('n:', 's_nationkey')},
         'IMPLEMENTS', 'deterministic', 'fk' FROM supplier
  UNION ALL SELECT {_id('oc:', 'o_orderkey')}, {_id('o:', 'o_orderkey')}, {_id('c:', 'o_custkey')},
         'CALLS', CASE o_orderstatus WHEN 'F' THEN 'deterministic' WHEN 'O' THEN 'probabilistic'
                  ELSE 'inferred' END, o_orderpriority FROM orders
  UNION ALL SELECT 'op:' || {_ROWKEY}, {_id('o:', 'l_orderkey')}, {_id('p:', 'l_partkey')},
         'USES', {_LINE_CONF}, l_linestatus FROM lineitem
  UNION ALL SELECT 'os:' || {_ROWKEY}, {_id('o:', 'l_orderkey')}, {_id('s:', 'l_suppkey')},
         'INJECTS', {_LINE_CONF}, l_linestatus FROM lineitem
)"""

ROOT_TABLES = {"region": ("r:", "r_regionkey"), "nation": ("n:", "n_nationkey"),
               "customer": ("c:", "c_custkey"), "supplier": ("s:", "s_suppkey"),
               "part": ("p:", "p_partkey"), "orders": ("o:", "o_orderkey")}

TIER = ("CASE {c} WHEN 'deterministic' THEN 0 WHEN 'probabilistic' THEN 1 ELSE 2 END")


def roots_cte(table: str) -> str:
    prefix, key = ROOT_TABLES[table]
    return f"roots AS MATERIALIZED (SELECT DISTINCT {_id(prefix, key)} AS root_id FROM {table})"


def arcs_cte(direction: str) -> str:
    out = ("SELECT source_node_id AS from_id, target_node_id AS to_id, edge_id, source_node_id, "
           "target_node_id, type, confidence FROM ent_edges")
    inb = ("SELECT target_node_id AS from_id, source_node_id AS to_id, edge_id, source_node_id, "
           "target_node_id, type, confidence FROM ent_edges")
    body = {"outbound": out, "inbound": inb, "both": f"{out} UNION ALL {inb}"}[direction]
    return f"arcs AS MATERIALIZED ({body})"


def bfs_ctes(depth: int, include_fringe: bool = False) -> str:
    """CTEs ``v0 .. vK`` (newly reached per hop) and ``vis`` (their union).

    Each level keeps the minimum over parents of the weakest tier on the
    path, the same rule as the DataFrame operator.
    """
    last = depth if include_fringe else depth - 1
    parts = ["v0 AS MATERIALIZED (SELECT root_id, root_id AS node_id, 0 AS hop, 0 AS wt FROM roots)"]
    for h in range(1, last + 1):
        tier = TIER.format(c="a.confidence")
        seen = f"SELECT root_id, node_id FROM s{h - 1}" if h > 1 else "SELECT root_id, node_id FROM v0"
        # the step's pairs first, then one anti join with everything seen so far
        parts.append(
            f"v{h} AS MATERIALIZED (SELECT t.root_id, t.node_id, {h} AS hop, t.wt FROM ("
            f"SELECT v.root_id, a.to_id AS node_id, MIN(GREATEST(v.wt, {tier})) AS wt "
            f"FROM v{h - 1} v JOIN arcs a ON a.from_id = v.node_id GROUP BY v.root_id, a.to_id) t "
            f"ANTI JOIN ({seen}) s ON s.root_id = t.root_id AND s.node_id = t.node_id)")
        parts.append(f"s{h} AS MATERIALIZED ({seen} UNION ALL SELECT root_id, node_id FROM v{h})")
    vis = " UNION ALL ".join(f"SELECT * FROM v{h}" for h in range(0, last + 1))
    parts.append(f"vis AS MATERIALIZED ({vis})")
    return ",\n".join(parts)


def visited_edges_sql(direction: str, depth: int) -> str:
    """Edges incident (in the direction) to nodes of hop <= depth-1, one row per edge."""
    rows = ("SELECT vis.root_id, a.edge_id, a.source_node_id, a.target_node_id, a.type, "
            f"a.confidence, vis.hop FROM vis JOIN arcs a ON a.from_id = vis.node_id "
            f"WHERE vis.hop <= {depth - 1}")
    if direction == "both":
        return ("SELECT root_id, edge_id, source_node_id, target_node_id, type, confidence, "
                "MIN(hop) AS hop, COUNT(*) AS times_seen FROM (" + rows + ") t "
                "GROUP BY root_id, edge_id, source_node_id, target_node_id, type, confidence")
    return ("SELECT root_id, edge_id, source_node_id, target_node_id, type, confidence, hop, "
            "CAST(1 AS BIGINT) AS times_seen FROM (" + rows + ") t")


KNN = """emb AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings),
nn AS (
  SELECT q, i, s FROM (
    SELECT a.vec_id AS q, b.vec_id AS i, list_dot_product(a.v, b.v) AS s,
           row_number() OVER (PARTITION BY a.vec_id
                              ORDER BY list_dot_product(a.v, b.v) DESC, b.vec_id) AS rn
    FROM emb a JOIN emb b ON a.vec_id <> b.vec_id) t
  WHERE rn <= 5),
knn AS (SELECT least(q, i) AS src, greatest(q, i) AS dst, max(s) AS score FROM nn GROUP BY 1, 2)"""


COR = """cor AS (
  SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS correction_id,
         CAST(conv_id AS VARCHAR) AS session_id, 'node' AS target_type,
         'conv:' || CAST(conv_id AS VARCHAR) AS target_id,
         prev_text AS original, text AS corrected, conv_id, turn
  FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev_role,
               lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prev_text
        FROM conversations) t
  WHERE role = 'user' AND prev_role = 'assistant')"""

QWORDS = """qw AS (
  SELECT DISTINCT item_id AS question_id, w AS word
  FROM (SELECT item_id, unnest(regexp_split_to_array(lower(text), '\\s+')) AS w FROM benchmark) t
  WHERE length(w) > 2)"""


def search_sql(cor_filter: str = "TRUE") -> str:
    return f"""SELECT DISTINCT qw.question_id, c.correction_id
FROM qw JOIN (SELECT correction_id,
                     lower(concat_ws(' ', COALESCE(original, ''), COALESCE(corrected, ''),
                                     COALESCE(target_id, ''))) AS s
              FROM cor WHERE {cor_filter}) c
  ON contains(c.s, qw.word)"""


RUN = """runs AS (
  SELECT event_id, ts, strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp, event_type AS sprint,
         'v00' || CAST(user_id % 7 AS VARCHAR) AS prompt_version,
         CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_type || '_v001' END AS suite_version,
         CASE WHEN user_id % 5 = 0 THEN NULL ELSE 'model-' || CAST(user_id % 3 AS VARCHAR) END
           AS orchestrator_model,
         CASE WHEN event_id % 13 = 0 THEN NULL ELSE value > 20 END AS passed,
         CAST(value AS DECIMAL(18,6)) AS cost_usd,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS in_tokens,
         event_id % 1000 AS out_tokens, event_id % 50 AS nodes, event_id % 30 AS edges,
         'runs/' || CAST(event_id AS VARCHAR) AS run_dir,
         (event_id % 17 = 0) AS canonical
  FROM events)"""


def rollup_sql(key: str) -> str:
    return f"""SELECT COALESCE(CAST({key} AS VARCHAR), 'unknown') AS {key},
       COUNT(*) AS runs,
       COUNT(*) FILTER (WHERE passed IS TRUE) AS passed,
       COUNT(*) FILTER (WHERE passed IS NOT TRUE) AS failed,
       CAST(ROUND(SUM(COALESCE(cost_usd, 0)), 6) AS DOUBLE) AS cost_usd,
       CAST(SUM(COALESCE(in_tokens, 0)) AS BIGINT) AS in_tokens,
       CAST(SUM(COALESCE(out_tokens, 0)) AS BIGINT) AS out_tokens,
       CAST(SUM(COALESCE(nodes, 0)) AS BIGINT) AS total_nodes,
       CAST(SUM(COALESCE(edges, 0)) AS BIGINT) AS total_edges
FROM runs GROUP BY 1"""


DUP = r"""dupkeys AS MATERIALIZED (
  SELECT doc_id, unnest([
    sha256('text:' || trim(regexp_replace(lower(text), '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ')),
    sha256('line:' || split_part(text, chr(10), 1))]) AS key
  FROM documents WHERE text IS NOT NULL),
dup AS MATERIALIZED (
  SELECT DISTINCT h.src, k.doc_id AS dst
  FROM dupkeys k JOIN (SELECT key, MIN(doc_id) AS src FROM dupkeys GROUP BY key HAVING COUNT(*) > 1) h ON h.key = k.key
  WHERE k.doc_id <> h.src)"""

DUP_COMPONENTS = """adj AS (SELECT src AS u, dst AS v FROM dup UNION SELECT dst, src FROM dup),
reach(id, r) AS (
  SELECT DISTINCT u, u FROM adj
  UNION
  SELECT reach.id, adj.v FROM reach JOIN adj ON adj.u = reach.r),
comp AS (
  SELECT d.doc_id AS id, COALESCE(MIN(reach.r), d.doc_id) AS component
  FROM documents d LEFT JOIN reach ON reach.id = d.doc_id GROUP BY d.doc_id),
sizes AS (SELECT component, COUNT(*) AS n_members,
                 MIN('doc:' || CAST(id AS VARCHAR)) AS first_member
          FROM comp GROUP BY component),
keep AS (SELECT * FROM sizes WHERE n_members > 1
         OR (SELECT MAX(n_members) FROM sizes) = 1),
members AS (
  SELECT 'comm:' || k.first_member AS community_id, 0 AS level, k.n_members,
         'doc:' || CAST(c.id AS VARCHAR) AS node_id, c.id AS doc_id
  FROM comp c JOIN keep k ON k.component = c.component)"""


URL_PATH = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
FIRST_SEG = "regexp_extract({c}, '^/*([^/]*)', 1)"
LINK_RX = "(?is)<a(?:\\s[^>]*)?\\shref\\s*=\\s*[\"'']([^\"''>]*)[\"'']"

LNK = f"""lnk_nodes AS (SELECT DISTINCT {URL_PATH} AS node_id FROM pages),
lnk_edges AS (
  SELECT 'l:' || CAST(page_id AS VARCHAR) || ':' || CAST(pos AS VARCHAR) AS edge_id,
         src AS source_node_id, hrefs[pos] AS target_node_id, 'LINKS' AS type,
         'deterministic' AS confidence
  FROM (SELECT page_id, {URL_PATH} AS src,
               regexp_extract_all(html, '{LINK_RX}', 1) AS hrefs FROM pages) p,
       LATERAL (SELECT unnest(generate_series(1, len(p.hrefs))) AS pos) g)"""

EXTS = "['py', 'ts', 'scss', 'cs', 'tsx', 'md', 'json', 'yml', 'proto', 'txt']"
DOC_FILES = f"""files AS (
  SELECT doc_id, lang AS file_type, source, text,
         source || '/doc_' || CAST(doc_id AS VARCHAR) || '.' || ({EXTS})[(doc_id % 10) + 1] AS path
  FROM documents)"""

REG = """reg AS (SELECT * FROM (VALUES ('x-en', 'en'), ('x-en', '.en'), ('x-fr', 'fr'), ('x-fr', '.fr'))
         t(skill_id, file_type))"""
