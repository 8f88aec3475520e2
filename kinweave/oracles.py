"""SQL that repeats the registered queries on the same tables, written pair by pair."""

from __future__ import annotations

ORDERS = """
defs AS (
  SELECT 'order:' || l_orderkey AS node_id, 'part:' || l_partkey AS identity_id, 'line_' || l_linenumber AS col,
    CASE min(l_suppkey) % 3 WHEN 0 THEN 'complete' WHEN 1 THEN 'partial' ELSE 'unknown' END AS universe,
    CASE max(l_returnflag) WHEN 'A' THEN true WHEN 'R' THEN false END AS uniq,
    CASE WHEN min(l_linestatus) = 'F' THEN true WHEN min(l_suppkey) % 5 <> 0 THEN false END AS total,
    CASE WHEN min(l_suppkey) % 3 = 0 THEN true WHEN min(l_suppkey) % 4 = 0 THEN false
         WHEN min(l_suppkey) % 4 <> 1 THEN true END AS conforms,
    max(l_quantity) AS quantity
  FROM lineitem GROUP BY l_orderkey, l_partkey, l_linenumber),
"""
EVENTS = """
seen AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL),
defs AS (
  SELECT 'user:' || user_id AS node_id, 'type:' || event_type AS identity_id, event_type AS col,
    CASE n % 3 WHEN 0 THEN 'complete' WHEN 1 THEN 'partial' ELSE 'unknown' END AS universe,
    CASE WHEN n % 4 = 0 THEN true WHEN n % 4 <> 1 THEN false END AS uniq,
    CASE WHEN n % 5 < 3 THEN true WHEN n % 5 = 3 THEN false END AS total,
    CASE WHEN n % 3 = 0 OR n % 2 = 0 THEN true END AS conforms
  FROM seen),
"""
MEMBERS = """
o AS (SELECT *, row_number() OVER (ORDER BY node_id, identity_id, col) AS ord FROM defs),
m AS (SELECT *, row_number() OVER (PARTITION BY identity_id ORDER BY ord) AS pos,
             count(*) OVER (PARTITION BY identity_id) AS size FROM o)
"""
STATUS_MEMBERS = """WITH defs AS (
  SELECT 'order:' || o_orderkey AS node_id, unnest(['status:' || o_orderstatus, 'priority:' || o_orderpriority]) AS identity_id,
    unnest(['status', 'priority']) AS col, CASE WHEN o_orderkey % 3 = 0 THEN 'complete' ELSE 'partial' END AS universe FROM orders),
""" + MEMBERS
ORDER_MEMBERS = "WITH " + ORDERS + MEMBERS
# Every definition as a row ``a`` beside the next one of its entity, ``b``.
ORDER_PEERS = ORDER_MEMBERS + """, pr AS MATERIALIZED (SELECT a, lead(a) OVER (PARTITION BY a.identity_id ORDER BY a.pos) AS b FROM m a)"""
EVENT_MEMBERS = "WITH " + EVENTS + MEMBERS
LARGEST = """
sales AS (SELECT o_orderkey, o_totalprice, c_custkey, n_nationkey, n_regionkey
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
"""


def largest(by: str) -> str:
    """The largest order per key: (req_id, node_id)."""
    return (
        f"SELECT {by} AS req_id, 'order:' || o_orderkey AS node_id FROM (SELECT *, row_number() OVER "
        f"(PARTITION BY {by} ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM sales) WHERE rn = 1"
    )


def mult(s: str, t: str) -> str:
    return (
        f"CASE WHEN {s}.uniq IS NULL OR {t}.uniq IS NULL THEN 'unknown' ELSE "
        f"CASE WHEN {s}.uniq THEN '1' ELSE 'many' END || ':' || CASE WHEN {t}.uniq THEN '1' ELSE 'many' END END"
    )


def exist(s: str, t: str) -> str:
    inside = f"(({s}.universe = 'complete' OR coalesce({s}.conforms, false)) AND {t}.universe = 'complete')"
    outside = f"(NOT {inside} AND {s}.universe = 'complete' AND {t}.universe = 'partial')"
    return (
        f"CASE WHEN coalesce(NOT {s}.total, false) OR {outside} THEN 'optional' "
        f"WHEN coalesce({s}.total, false) AND {inside} THEN 'always' ELSE 'unknown' END"
    )


def _unknown(names: list[tuple[str, str]]) -> str:
    parts = ", ".join(f"CASE WHEN {value} = 'unknown' THEN '{name}' END" for name, value in sorted(names))
    return f"concat_ws('|', {parts})"


def _sources() -> dict[str, str]:
    return {
        "ingest_findings": """SELECT 'c' || c_custkey || '.yaml:' || place AS location, rule, message FROM customer JOIN (VALUES
  (0, '$', 'yaml_syntax', 'broken'), (1, '$.nodes[0].grain', 'missing', 'field required'),
  (2, '$.nodes[0].accessor.port', 'extra_forbidden', 'unsupported field'),
  (3, '$.nodes[0].accessor.endpoint', 'string_type', 'value has the wrong type'),
  (4, '$.logical_identities.k.synonyms', 'list_type', 'value has the wrong type'),
  (5, '$.nodes[0].entity_definitions[0].unique', 'claim_domain', 'value has the wrong type')) f(kind, place, rule, message)
ON c_custkey % 7 = kind""",
        "manifest_findings": """WITH o AS (SELECT o_orderkey AS k, o_orderkey % 5 AS kind FROM orders)
SELECT 'manifest:$.nodes[' || k * 2 || ']' AS location, CASE kind WHEN 0 THEN 'missing_file' WHEN 1 THEN 'unsupported_file' ELSE 'invalid_collection_path' END AS rule,
  CASE kind WHEN 0 THEN 'listed collection file does not exist: nodes/' || k || '.yaml' WHEN 1 THEN 'collection paths must name .yaml or .yml files'
    ELSE 'collection paths must be relative and must not contain ''..''' END AS message
FROM o WHERE kind < 3
UNION ALL SELECT 'manifest:$.nodes[' || (k * 2 + 1) || ']', 'duplicate_manifest_path', 'collection path is already owned by nodes' FROM o WHERE kind = 3
UNION ALL SELECT 'extra/' || c_custkey || '.yml', 'unlisted_file', 'file is not listed in the manifest' FROM customer WHERE c_custkey % 2 = 0
UNION ALL SELECT 'notes/' || c_custkey || '.txt', 'unsupported_file', 'the folder may contain only .yaml or .yml files' FROM customer WHERE c_custkey % 2 = 1""",
    }


def _relationships() -> dict[str, str]:
    ab, ae, ba, be = mult("a", "b"), exist("a", "b"), mult("b", "a"), exist("b", "a")
    profile = f"""
SELECT a.identity_id, {ab} AS multiplicity, {ae} AS match_existence, {ba} AS reverse_multiplicity,
  {be} AS reverse_match_existence, count(*) AS edge_count
FROM m a JOIN m b ON a.identity_id = b.identity_id AND a.ord <> b.ord GROUP BY ALL"""
    unknown = _unknown([("a_to_b.multiplicity", ab), ("a_to_b.match_existence", ae), ("b_to_a.multiplicity", ba), ("b_to_a.match_existence", be)])
    from_a = "(x.from_node = a.node_id)"
    picked = {
        "multiplicity": f"CASE WHEN {from_a} THEN {ab} ELSE {ba} END", "match_existence": f"CASE WHEN {from_a} THEN {ae} ELSE {be} END",
        "reverse_multiplicity": f"CASE WHEN {from_a} THEN {ba} ELSE {ab} END", "reverse_match_existence": f"CASE WHEN {from_a} THEN {be} ELSE {ae} END",
    }
    edge_unknown = _unknown([
        ("direction.multiplicity", picked["multiplicity"]), ("direction.match_existence", picked["match_existence"]),
        ("reverse_direction.multiplicity", picked["reverse_multiplicity"]), ("reverse_direction.match_existence", picked["reverse_match_existence"]),
    ])
    supply = """WITH p AS (SELECT l_partkey, l_suppkey, count(DISTINCT l_orderkey) AS n, max(l_returnflag) AS flag, min(l_linestatus) AS status
  FROM lineitem GROUP BY ALL),
s AS (SELECT 'part:' || l_partkey AS left_id, 'supplier:' || l_suppkey AS right_id,
  CASE WHEN n = 1 THEN '1:many' WHEN flag = 'R' THEN 'many:many' WHEN flag = 'A' THEN 'many:1' ELSE 'unknown' END AS multiplicity,
  CASE status WHEN 'F' THEN 'always' ELSE 'optional' END AS me_left, CASE flag WHEN 'A' THEN 'unknown' ELSE 'optional' END AS me_right,
  'ordered ' || n || ' times' AS descriptions,
  row_number() OVER (ORDER BY 'part:' || l_partkey, 'supplier:' || l_suppkey) AS x_ord FROM p)"""
    mirror = "CASE multiplicity WHEN '1:many' THEN 'many:1' WHEN 'many:1' THEN '1:many' ELSE multiplicity END"
    both = f""", c AS (SELECT left_id AS identity_id, right_id AS other_id, x_ord, descriptions, multiplicity,
  me_left AS match_existence, me_right AS reverse_match_existence FROM s
UNION ALL SELECT right_id, left_id, x_ord, descriptions, {mirror}, me_right, me_left FROM s)"""
    stated_unknown = _unknown([(n, n) for n in ("match_existence", "multiplicity", "reverse_match_existence")])
    brand = """, ends AS (SELECT p_brand AS req_id,
  'part:' || first(p_partkey ORDER BY p_retailprice, p_partkey) AS a, 'part:' || last(p_partkey ORDER BY p_retailprice, p_partkey) AS b
  FROM part GROUP BY p_brand)"""
    # Parts and suppliers alternate, so paths of at most three steps between parts have two.
    two = brand + """, found AS (SELECT req_id, x.identity_id AS a, x.other_id AS v, y.other_id AS b,
  row_number() OVER (PARTITION BY req_id ORDER BY x.other_id) AS rank, count(*) OVER (PARTITION BY req_id) AS n
  FROM ends e JOIN c x ON x.identity_id = e.a JOIN c y ON y.identity_id = x.other_id AND y.other_id = e.b WHERE e.a <> e.b)"""
    return {
        "membership_positions": ORDER_MEMBERS + "SELECT node_id, identity_id, col AS columns, ord, pos, size FROM m",
        "column_ordinals": "SELECT node_id, name, row_number() OVER (ORDER BY node_id, name) AS c_ord FROM (SELECT DISTINCT 'order:' || l_orderkey AS node_id, 'line_' || l_linenumber AS name FROM lineitem)",
        "relationship_ordinals": supply + "SELECT left_id, right_id, x_ord FROM s",
        "relationship_pages": EVENT_MEMBERS + f"""SELECT a.ord AS lo, b.ord AS hi, 'D' || a.ord || '-D' || b.ord AS edge_id, a.identity_id,
  a.node_id AS a_node_id, b.node_id AS b_node_id, {ab} AS ab_multiplicity, {ae} AS ab_existence, {ba} AS ba_multiplicity,
  {be} AS ba_existence, {unknown} AS unknown_fields, (a.size - a.pos)::BIGINT AS pair_total, a.size - a.pos > 200 AS more
FROM m a JOIN m b ON a.identity_id = b.identity_id AND b.pos BETWEEN a.pos + 1 AND a.pos + 200""",
        "relationship_profile": ORDER_MEMBERS + profile,
        "relationship_profile_hubs": EVENT_MEMBERS + profile,
        "dataset_degrees": ORDER_MEMBERS + """SELECT coalesce(d.node_id, 'order:' || o_orderkey) AS node_id, coalesce(d.edge_count, 0) AS edge_count
FROM orders FULL JOIN (SELECT node_id, sum(size - 1)::BIGINT AS edge_count FROM m GROUP BY node_id) d ON d.node_id = 'order:' || o_orderkey""",
        "relationship_lookup": ORDER_PEERS + f""", x AS (SELECT a, CASE WHEN a.pos % 64 <> 0 THEN b END AS b,
    CASE a.ord % 3 WHEN 0 THEN a.node_id WHEN 1 THEN 'order:none' END AS from_node FROM pr),
j AS (SELECT *, CASE WHEN b IS NULL THEN 'unknown_relationship' WHEN from_node IS NULL THEN 'ok'
    WHEN from_node = 'order:none' THEN 'not_endpoint' WHEN a.node_id = b.node_id THEN 'ambiguous' ELSE 'ok' END AS status FROM x)
SELECT a.ord AS req_id, 'D' || a.ord || '-D' || coalesce(b.ord, a.ord) AS edge_id, status, CASE WHEN b IS NOT NULL THEN a.ord END AS lo, b.ord AS hi,
  CASE WHEN b IS NOT NULL THEN {ab} END AS ab_multiplicity, CASE WHEN b IS NOT NULL THEN {be} END AS ba_existence,
  CASE WHEN status = 'ok' AND from_node IS NOT NULL THEN a.node_id || '[' || a.col || '] -> ' || b.node_id || '[' || b.col || ']' END AS edge,
  CASE WHEN status = 'ok' AND from_node IS NOT NULL THEN {picked['multiplicity']} END AS multiplicity,
  CASE WHEN status = 'ok' AND from_node IS NOT NULL THEN {picked['match_existence']} END AS match_existence,
  CASE WHEN status = 'ok' AND from_node IS NOT NULL THEN {edge_unknown} END AS edge_unknown_fields
FROM j x""",
        "effective_descriptions": ORDER_MEMBERS + """, flags AS (SELECT 'order:' || l_orderkey AS node_id, 'line_' || l_linenumber AS col, max(l_returnflag) AS flag FROM lineitem GROUP BY ALL),
e AS (SELECT m.node_id, identity_id, col, quantity, CASE WHEN quantity > 45 THEN 'bulk line' WHEN (quantity > 25 OR quantity <= 10) AND flag <> 'N' THEN 'line with flag ' || flag END AS t FROM m JOIN flags USING (node_id, col))
SELECT node_id, identity_id, col AS dataset_columns, t AS effective_description, CASE WHEN quantity > 45 THEN 'entity' WHEN t IS NOT NULL THEN 'column' END AS description_source FROM e""",
        "stated_claims": supply + both + f"SELECT *, {stated_unknown} AS unknown_fields FROM c",
        "entity_relationship_pages": supply + both + """, r AS (SELECT c.*, row_number() OVER (PARTITION BY identity_id ORDER BY other_id) AS rank, count(*) OVER (PARTITION BY identity_id) AS total FROM c)
SELECT s_suppkey AS req_id, 'ok' AS status, coalesce(total, 0) AS total, rank, other_id, p_name AS name, multiplicity, match_existence
FROM supplier LEFT JOIN (SELECT * FROM r WHERE rank <= 50) r ON r.identity_id = 'supplier:' || s_suppkey LEFT JOIN part ON other_id = 'part:' || p_partkey""",
        "entity_paths": supply + both + two + "SELECT req_id, rank, 2::BIGINT AS step_count, a || '|' || v || '|' || b AS ids, n > 3 AS truncated FROM found WHERE rank <= 3",
        "part_paths": supply + """, nb AS MATERIALIZED (SELECT left_id AS x, right_id AS y FROM s UNION ALL SELECT right_id, left_id FROM s)
, ends AS MATERIALIZED (SELECT p_partkey AS req_id, 'part:' || p_partkey AS a, 'part:' || lead(p_partkey) OVER (ORDER BY p_partkey) AS b FROM part)
, two AS MATERIALIZED (SELECT req_id, [a, p.y, b] AS ids FROM ends JOIN nb p ON p.x = a JOIN nb q ON q.x = p.y AND q.y = b)
, lack AS (SELECT ends.* FROM ends LEFT JOIN (SELECT req_id, count(*) AS n FROM two GROUP BY req_id) USING (req_id) WHERE b IS NOT NULL AND coalesce(n, 0) <= 3)
, ha AS (SELECT req_id, a, b, p.y AS v, q.y AS w FROM lack JOIN nb p ON p.x = a JOIN nb q ON q.x = p.y WHERE q.y NOT IN (a, b))
, hb AS (SELECT req_id, p.y AS v, q.y AS w FROM lack JOIN nb p ON p.x = b JOIN nb q ON q.x = p.y)
, four AS (SELECT req_id, [a, ha.v, w, hb.v, b] AS ids FROM ha JOIN hb USING (req_id, w) WHERE ha.v <> hb.v)
, g AS (SELECT *, row_number() OVER (PARTITION BY req_id ORDER BY len(ids), ids) AS rank, count(*) OVER (PARTITION BY req_id) AS n
  FROM (SELECT * FROM two UNION ALL SELECT * FROM four))
SELECT req_id, rank, (len(ids) - 1)::BIGINT AS step_count, array_to_string(ids, '|') AS ids, n > 3 AS truncated FROM g WHERE rank <= 3""",
        "entity_path_steps": supply + both + two + """, steps AS (SELECT req_id, rank, 1::BIGINT AS step, a AS from_id, v AS to_id FROM found WHERE rank <= 3
UNION ALL SELECT req_id, rank, 2, v, b FROM found WHERE rank <= 3)
SELECT req_id, rank, step, from_id, to_id, multiplicity, match_existence FROM steps JOIN c ON c.identity_id = from_id AND c.other_id = to_id""",
    }


def _discovery() -> dict[str, str]:
    parts = ", req AS (SELECT p_partkey AS req_id, 'part:' || p_partkey AS identity_id, p_size > 10 AS narrowed FROM part)" + """
, prim AS (SELECT r.req_id, r.identity_id, m.node_id, m.ord FROM req r JOIN m ON m.identity_id = r.identity_id
  WHERE NOT narrowed OR universe IN ('complete', 'partial'))"""
    types = ", kinds AS (SELECT DISTINCT event_type FROM events)" + """
, prim AS (SELECT k.event_type AS req_id, m.identity_id, m.node_id, m.ord FROM kinds k JOIN m ON m.identity_id = 'type:' || k.event_type
  WHERE universe IN ('complete', 'unknown') AND NOT EXISTS (SELECT 1 FROM kinds e WHERE e.event_type < k.event_type
    AND NOT EXISTS (SELECT 1 FROM m x WHERE x.node_id = m.node_id AND x.identity_id = 'type:' || e.event_type)))"""
    top = """, g AS (SELECT req_id, identity_id, count(*) AS entity_definition_count, count(DISTINCT node_id) AS dataset_count FROM held GROUP BY ALL)
, r AS (SELECT *, row_number() OVER (PARTITION BY req_id ORDER BY entity_definition_count DESC, identity_id) AS rank, count(*) OVER (PARTITION BY req_id) AS logical_entity_count FROM g)
SELECT req_id, rank, identity_id, p_name AS name, entity_definition_count, dataset_count, logical_entity_count, logical_entity_count > 20 AS truncated
FROM r LEFT JOIN part ON identity_id = 'part:' || p_partkey WHERE rank <= 20"""
    sources = ", src AS (SELECT q.req_id, m.* FROM req q JOIN m ON m.node_id = q.node_id)"
    counted = """, l AS (SELECT s.req_id, s.ord AS s_ord, t.ord AS t_ord, row_number() OVER (PARTITION BY s.req_id, s.ord ORDER BY t.ord) AS rank,
  count(*) OVER (PARTITION BY s.req_id, s.ord) AS edge_count FROM src s JOIN tgt t ON t.identity_id = s.identity_id AND t.ord <> s.ord {on})
, mx AS (SELECT req_id, max(edge_count) AS most FROM l GROUP BY req_id)"""

    def customers(by: str) -> str:
        return f", {LARGEST}, req AS ({largest(by)})"

    plain = counted.format(on="")
    near = ", conn AS (SELECT DISTINCT s.req_id, t.node_id FROM src s JOIN m t ON t.identity_id = s.identity_id AND t.node_id <> s.node_id)"
    return {
        "entity_counts": ORDER_MEMBERS + parts + """, c AS (SELECT req_id, count(DISTINCT node_id) AS d, count(*) AS n FROM prim GROUP BY req_id)
SELECT req_id, identity_id, coalesce(d, 0) AS dataset_count, coalesce(n, 0) AS primary_definition_count, 'ok' AS status,
  CASE WHEN coalesce(d, 0) > 25 THEN 'aggregated' ELSE 'detailed' END AS view FROM req LEFT JOIN c USING (req_id)""",
        "entity_histogram": ORDER_MEMBERS + parts + """, n AS (SELECT DISTINCT req_id, identity_id AS own, node_id FROM prim)
, held AS (SELECT req_id, n.node_id, m.identity_id FROM n JOIN m ON m.node_id = n.node_id AND m.identity_id <> own)""" + top,
        "entity_counts_with_targets": EVENT_MEMBERS + types + """, c AS (SELECT req_id, count(DISTINCT node_id) AS d, count(*) AS n FROM prim GROUP BY req_id)
SELECT event_type AS req_id, 'type:' || event_type AS identity_id, coalesce(d, 0) AS dataset_count, coalesce(n, 0) AS primary_definition_count,
  'ok' AS status, CASE WHEN coalesce(d, 0) > 200 THEN 'aggregated' ELSE 'detailed' END AS view FROM kinds LEFT JOIN c ON req_id = event_type""",
        "entity_definition_page": EVENT_MEMBERS + types + """, n AS (SELECT req_id, node_id, row_number() OVER (PARTITION BY req_id ORDER BY node_id) AS dataset_rank,
  count(*) OVER (PARTITION BY req_id) AS dataset_count FROM (SELECT DISTINCT req_id, node_id FROM prim))
SELECT n.req_id, dataset_rank, n.node_id, m.ord, m.identity_id, m.col AS dataset_columns, p.ord IS NOT NULL AS is_primary, dataset_count,
  least(dataset_count, 35) - 5 < dataset_count AS truncated, dataset_count > 35 AS more
FROM n JOIN m ON m.node_id = n.node_id LEFT JOIN prim p ON p.req_id = n.req_id AND p.ord = m.ord
WHERE dataset_rank BETWEEN 6 AND 35 AND (p.ord IS NOT NULL OR m.identity_id < 'type:' || n.req_id)""",
        "fan_out": ORDER_MEMBERS + customers("c_custkey") + sources + near + """SELECT q.req_id, q.node_id, coalesce(n, 0) AS fan_out_count, 'ok' AS status,
  CASE WHEN coalesce(n, 0) > 100 THEN 'aggregated' ELSE 'detailed' END AS view
FROM req q LEFT JOIN (SELECT req_id, count(*) AS n FROM conn GROUP BY req_id) c USING (req_id)""",
        "edge_histogram": ORDER_MEMBERS + customers("n_nationkey") + sources + near + ", held AS (SELECT req_id, c.node_id, m.identity_id FROM conn c JOIN m USING (node_id))" + top,
        "deep_entity_page": STATUS_MEMBERS + """, n AS (SELECT substr(identity_id, 8) AS req_id, *, row_number() OVER (PARTITION BY identity_id ORDER BY node_id) AS dataset_rank,
  count(*) OVER (PARTITION BY identity_id) AS dataset_count FROM m WHERE starts_with(identity_id, 'status:') AND universe = 'partial')
SELECT req_id, dataset_rank, node_id, ord, dataset_count, true AS truncated, dataset_count > 1400 AS more FROM n WHERE dataset_rank BETWEEN 1101 AND 1400""",
        "deep_edge_page": STATUS_MEMBERS + """, r AS (SELECT min(o_orderkey) AS req_id, 'priority:' || o_orderpriority AS target FROM orders GROUP BY o_orderstatus, o_orderpriority),
p AS (SELECT r.req_id, s.ord AS s_ord, t.ord AS t_ord, row_number() OVER (PARTITION BY r.req_id, s.ord ORDER BY t.ord) AS rank,
    count(*) OVER (PARTITION BY r.req_id, s.ord) AS edge_count
  FROM r JOIN m s ON s.node_id = 'order:' || r.req_id JOIN m t ON t.identity_id = s.identity_id AND t.ord <> s.ord
  JOIN m g ON g.node_id = t.node_id AND g.identity_id = r.target)
SELECT req_id, s_ord, t_ord, rank, edge_count, max(edge_count) OVER (PARTITION BY req_id) > 1150 AS more, true AS truncated FROM p
QUALIFY rank BETWEEN 1101 AND 1150""",
        "deep_relationship_page": STATUS_MEMBERS + """, x AS (SELECT *, row_number() OVER (ORDER BY c, s) AS x_ord FROM (
  SELECT DISTINCT 'customer:' || o_custkey AS c, 'status:' || o_orderstatus AS s FROM orders)),
p AS (SELECT substr(s, 8) AS req_id, c, x_ord, row_number() OVER (PARTITION BY s ORDER BY c) AS rank, count(*) OVER (PARTITION BY s) AS total FROM x)
SELECT q.req_id, 'ok' AS status, q.total, p.rank, p.c AS other_id, c_name AS name, 'X' || p.x_ord AS id
FROM (SELECT DISTINCT req_id, total FROM p) q LEFT JOIN (SELECT * FROM p WHERE rank BETWEEN 1101 AND 1500) p USING (req_id)
LEFT JOIN customer ON p.c = 'customer:' || c_custkey""",
        "edge_page": ORDER_MEMBERS + customers("c_custkey") + sources + ", tgt AS (SELECT * FROM m)" + plain + f"""
SELECT l.req_id, s_ord, t_ord, rank, edge_count, most > 20 AS more, least(edge_count - 10, 10) < edge_count AS truncated,
  {mult('a', 'b')} AS multiplicity, {exist('a', 'b')} AS match_existence
FROM l JOIN mx USING (req_id) JOIN m a ON a.ord = s_ord JOIN m b ON b.ord = t_ord WHERE rank BETWEEN 11 AND 20""",
        "edge_page_with_targets": EVENT_MEMBERS + """, req AS (SELECT user_id AS req_id, 'user:' || user_id AS node_id, 'type:' || min(event_type) AS target FROM events GROUP BY user_id)""" + sources + """
, tgt AS (SELECT q.req_id AS rid, m.* FROM req q JOIN m w ON w.identity_id = q.target JOIN m ON m.node_id = w.node_id)""" + counted.format(on="AND t.rid = s.req_id") + """
SELECT req_id, s_ord, t_ord, rank, edge_count, most > 7 AS more, least(edge_count - 2, 5) < edge_count AS truncated FROM l JOIN mx USING (req_id) WHERE rank BETWEEN 3 AND 7""",
        "edge_groups": ORDER_MEMBERS + """, flags AS (SELECT 'order:' || l_orderkey AS node_id, 'line_' || l_linenumber AS col, max(l_returnflag) AS flag FROM lineitem GROUP BY ALL)
, txt AS (SELECT m.ord, CASE WHEN quantity > 45 THEN 'bulk line' WHEN (quantity > 25 OR quantity <= 10) AND flag <> 'N' THEN 'line with flag ' || flag ELSE '-' END AS t FROM m JOIN flags USING (node_id, col))"""
        + customers("n_nationkey") + sources + ", tgt AS (SELECT * FROM m)" + plain + """
SELECT l.req_id, a.node_id, a.identity_id, 'D' || s_ord AS id, edge_count, edge_count > 12 AS truncated,
  string_agg(a.node_id || '[' || a.col || '] -> ' || b.node_id || '[' || b.col || ']', '|' ORDER BY rank) AS edges, string_agg(t, '|' ORDER BY rank) AS texts
FROM l JOIN m a ON a.ord = s_ord JOIN m b ON b.ord = t_ord JOIN txt ON txt.ord = s_ord WHERE rank <= 12 GROUP BY ALL""",
        "dataset_records": ORDER_MEMBERS + """SELECT 'order:' || o_orderkey AS node_id, 'sales.orders.' || o_orderkey AS qualified_name, coalesce(d.n, 0) AS edge_count,
  'table' AS kind, o_orderstatus AS label, o_orderpriority AS description, CASE WHEN o_orderstatus = 'P' THEN 'grain' ELSE '' END AS unknown_fields, 'ok' AS status
FROM orders LEFT JOIN (SELECT node_id, sum(size - 1)::BIGINT AS n FROM m GROUP BY node_id) d ON d.node_id = 'order:' || o_orderkey""",
    }


def _traversal() -> dict[str, str]:
    seeds = ", " + LARGEST + ", req AS (" + largest("n_nationkey") + ")"
    levels = """
, nb AS (SELECT DISTINCT a.node_id AS x, b.node_id AS y FROM m a JOIN m b ON a.identity_id = b.identity_id AND a.node_id <> b.node_id)
, l1 AS (SELECT DISTINCT req_id, y AS node_id FROM req JOIN nb ON x = node_id)
, l2 AS (SELECT DISTINCT l1.req_id, y AS node_id FROM l1 JOIN nb ON x = l1.node_id)
, every AS (SELECT req_id, node_id, min(d) AS distance FROM (SELECT req_id, node_id, 0::BIGINT AS d FROM req UNION ALL SELECT *, 1 FROM l1 UNION ALL SELECT *, 2 FROM l2) GROUP BY ALL)
, ranked AS (SELECT *, row_number() OVER (PARTITION BY req_id ORDER BY distance, node_id) AS rank, count(*) OVER (PARTITION BY req_id) AS reached FROM every)"""
    def pairs(by: str) -> str:
        return ", " + LARGEST + ", best AS (" + largest(by) + """)
, ends AS (SELECT a.req_id, a.node_id AS src, b.node_id AS dst FROM best a JOIN best b ON b.req_id = a.req_id + 1)"""

    def hop(s: str, t: str, allowed: str) -> str:
        return f"{t}.identity_id = {s}.identity_id AND {t}.ord <> {s}.ord{allowed.format(m=mult(s, t)) if allowed else ''}"

    def edge(s: str, t: str) -> str:
        return f"struct_pack(lo := least({s}, {t}), hi := greatest({s}, {t}), start := {s})"

    def distinct(*names: str) -> str:
        return " AND ".join(f"{x} <> {y}" for i, x in enumerate(names) for y in names[i + 1 :])

    def k_paths(by: str, k: int, longest: int, allowed: str) -> str:
        """First edges of all requests meet their last edges, directly or over one edge between; over two where paths lack."""
        return ORDER_MEMBERS.replace("m AS (", "m AS MATERIALIZED (") + pairs(by) + f"""
, f1 AS MATERIALIZED (SELECT e.req_id, e.dst, s.ord AS s1, t.ord AS t1, t.node_id AS v
  FROM ends e JOIN m s ON s.node_id = e.src JOIN m t ON {hop('s', 't', allowed)})
, bk AS MATERIALIZED (SELECT e.req_id, s.ord AS sl, t.ord AS tl, s.node_id AS v
  FROM ends e JOIN m t ON t.node_id = e.dst JOIN m s ON {hop('s', 't', allowed)} WHERE s.node_id <> e.dst)
, a AS MATERIALIZED (SELECT f.req_id, f.dst, s1, t1, s.ord, s.identity_id, s.uniq FROM f1 f JOIN m s ON s.node_id = f.v AND s.ord <> t1 AND s.ord <> s1 WHERE f.v <> f.dst)
, b AS MATERIALIZED (SELECT k.req_id, sl, tl, t.ord, t.identity_id, t.uniq FROM bk k JOIN m t ON t.node_id = k.v AND t.ord <> sl AND t.ord <> tl)
, upto AS MATERIALIZED (
  SELECT req_id, [{edge('s1', 't1')}] AS edges FROM f1 WHERE v = dst
  UNION ALL SELECT f.req_id, [{edge('s1', 't1')}, {edge('sl', 'tl')}] FROM f1 f JOIN bk k ON k.req_id = f.req_id AND k.v = f.v WHERE {distinct('s1', 't1', 'sl', 'tl')}
  UNION ALL SELECT a.req_id, [{edge('s1', 't1')}, {edge('a.ord', 'b.ord')}, {edge('sl', 'tl')}] FROM a JOIN b ON b.req_id = a.req_id AND {hop('a', 'b', allowed)}
    WHERE {distinct('s1', 't1', 'a.ord', 'b.ord', 'sl', 'tl')})
, lack AS (SELECT req_id FROM ends LEFT JOIN (SELECT req_id, count(*) AS n FROM upto GROUP BY req_id) USING (req_id) WHERE {longest} > 3 AND coalesce(n, 0) <= {k})
, a2 AS (SELECT a.req_id, s1, t1, a.ord AS s2, t.ord AS t2, t.node_id AS v FROM a JOIN lack USING (req_id) JOIN m t ON {hop('a', 't', allowed)}
  WHERE t.node_id <> a.dst AND t.ord <> s1 AND t.ord <> t1)
, a3 AS (SELECT x.req_id, s1, t1, s2, t2, s.ord, s.identity_id, s.uniq FROM a2 x JOIN m s ON s.node_id = x.v AND s.ord NOT IN (s1, t1, s2, t2))
, f AS (SELECT * FROM upto UNION ALL SELECT a.req_id, [{edge('s1', 't1')}, {edge('s2', 't2')}, {edge('a.ord', 'b.ord')}, {edge('sl', 'tl')}]
  FROM a3 a JOIN b ON b.req_id = a.req_id AND {hop('a', 'b', allowed)} WHERE {distinct('s1', 't1', 's2', 't2', 'a.ord', 'b.ord', 'sl', 'tl')})
, g AS (SELECT *, row_number() OVER (PARTITION BY req_id ORDER BY len(edges), edges) AS rank, count(*) OVER (PARTITION BY req_id) AS n FROM f)
SELECT req_id, rank, len(edges) AS edge_count, array_to_string(list_transform(edges, lambda e: e.lo || ':' || e.hi || ':' || e.start), '|') AS edges, n > {k} AS truncated FROM g WHERE rank <= {k}"""

    return {
        "neighbourhood": ORDER_MEMBERS + seeds + levels + "SELECT req_id, node_id, distance, rank, reached, 'ok' AS status FROM ranked WHERE rank <= 1000",
        "customer_neighbourhood": ORDER_MEMBERS + ", " + LARGEST + ", req AS (" + largest("c_custkey") + ")" + levels
        + "SELECT req_id, node_id, distance, rank, reached, 'ok' AS status FROM ranked WHERE rank <= 20",
        "neighbourhood_edges": ORDER_MEMBERS + seeds + levels + """, kept AS (SELECT * FROM ranked WHERE rank <= 60)
, src AS (SELECT k.req_id, m.*, size - 1 AS edge_count FROM kept k JOIN m USING (node_id) WHERE distance < 2 AND size > 1)
, tgt AS (SELECT k.req_id, m.identity_id, m.ord FROM kept k JOIN m USING (node_id))
, l AS (SELECT s.req_id, s.ord AS s_ord, t.ord AS t_ord, s.edge_count, row_number() OVER (PARTITION BY s.req_id, s.ord ORDER BY t.ord) AS rn
  FROM src s LEFT JOIN tgt t ON t.req_id = s.req_id AND t.identity_id = s.identity_id AND t.ord <> s.ord)
, c AS (SELECT *, count(t_ord) OVER (PARTITION BY req_id, s_ord) AS listed FROM l WHERE rn <= 3)
SELECT req_id, s_ord, t_ord, CASE WHEN t_ord IS NOT NULL THEN rn END AS rank, edge_count, listed FROM c""",
        "shortest_paths": k_paths("n_regionkey", 6, 3, ""),
        "customer_paths": k_paths("c_custkey", 6, 4, ""),
        "shortest_paths_by_multiplicity": k_paths("n_regionkey", 4, 3, " AND {m} IN ('1:1', 'many:1', '1:many')"),
        "order_components": """WITH a AS (SELECT o_custkey, o_orderkey, o_orderstatus, coalesce(lag(o_orderstatus) OVER w = o_orderstatus, false) AS same FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
b AS (SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS run FROM a)
SELECT o_custkey AS group_id, o_orderkey AS node, min(o_orderkey) OVER (PARTITION BY o_custkey, run) AS label FROM b""",
    }


def _checks() -> dict[str, str]:
    loc = """'nodes["' || node_id || '"]'"""
    held = f"""{loc} || '.entity_definitions[["' || identity_id || '",["' || col || '"]]].'"""
    part = "cast(substr(identity_id, 6) AS BIGINT)"
    keys = " UNION ALL ".join(
        f"""SELECT '{table}:{",".join(k)}' AS key, cast(sum(n) AS BIGINT) AS record_count, count(*) FILTER (WHERE ok) AS key_count,
coalesce(cast(sum(n) FILTER (WHERE NOT ok) AS BIGINT), 0) AS null_count, coalesce(max(n) FILTER (WHERE ok), 0) <= 1 AS "unique", coalesce(sum(n) FILTER (WHERE NOT ok), 0) = 0 AS total
FROM (SELECT count(*) AS n, {" AND ".join(f"{c} IS NOT NULL" for c in k)} AS ok FROM {table} GROUP BY {", ".join(k)})"""
        for table, k in (
            ("lineitem", ["l_orderkey", "l_linenumber"]), ("lineitem", ["l_orderkey", "l_partkey"]), ("orders", ["o_orderkey"]),
            ("orders", ["o_custkey"]), ("part", ["p_name"]), ("events", ["user_id", "event_type"]), ("conversations", ["conv_id", "turn"]),
        )
    )
    contained = " UNION ALL ".join(
        f"""SELECT '{t}:{k}' AS key, a AS orphan_count, b AS absent_count, a = 0 AS conforms, CASE WHEN a = 0 AND b = 0 THEN 'complete' ELSE 'partial' END AS entity_universe FROM
(SELECT (SELECT count(DISTINCT {k}) FROM {t} WHERE {k} NOT IN (SELECT {ok} FROM {o})) AS a, (SELECT count(DISTINCT {ok}) FROM {o} WHERE {ok} NOT IN (SELECT {k} FROM {t})) AS b)"""
        for t, k, o, ok in (
            ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("orders", "o_custkey", "customer", "c_custkey"),
            ("lineitem", "l_partkey", "part", "p_partkey"), ("labels", "doc_id", "documents", "doc_id"),
        )
    )
    return {
        "integrity_findings": ORDER_MEMBERS + f"""
SELECT 'duplicate_node' AS rule, 'order:' || o_orderkey AS node_id, NULL::VARCHAR AS identity_id FROM orders WHERE o_orderkey % 50 = 1
UNION ALL SELECT 'missing_column', node_id, identity_id FROM m WHERE col = 'line_7' AND cast(substr(node_id, 7) AS BIGINT) % 5 = 0
UNION ALL SELECT DISTINCT 'unknown_identity', node_id, identity_id FROM m WHERE {part} % 10 = 3
UNION ALL SELECT 'complete_must_conform', node_id, identity_id FROM m WHERE {part} % 20 = 5 AND universe = 'complete'
UNION ALL SELECT 'blank', NULL, 'part:' || p_partkey FROM part WHERE p_partkey % 100 = 7
UNION ALL SELECT 'claim_domain', node_id, identity_id FROM m WHERE {part} % 100 = 9
UNION ALL SELECT 'grain_column', 'order:' || o_orderkey, NULL FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 1)""",
        "unknown_claims": ORDER_MEMBERS + f"""
SELECT 'dataset' AS object_kind, 'grain' AS claim, 'nodes["order:' || o_orderkey || '"].grain' AS location FROM orders WHERE o_orderstatus = 'P'
UNION ALL SELECT 'entity_definition', 'conforms', {held} || 'conforms' FROM m WHERE conforms IS NULL
UNION ALL SELECT 'entity_definition', 'entity_universe', {held} || 'entity_universe' FROM m WHERE universe = 'unknown'
UNION ALL SELECT 'entity_definition', 'total', {held} || 'total' FROM m WHERE total IS NULL
UNION ALL SELECT 'entity_definition', 'unique', {held} || 'unique' FROM m WHERE uniq IS NULL""",
        "accessor_warnings": """WITH a AS (SELECT 'order:' || o_orderkey AS node_id, length('{"endpoint":"orders","kind":"table","labels":{"status":"' || o_orderstatus || '"},"properties":{"key":"' || o_orderkey || '"}}') AS length FROM orders)
SELECT node_id, length, 'nodes[' || node_id || '].accessor: ' || length || ' characters exceeds the 87-character soft limit' AS message FROM a WHERE length > 87""",
        "catalog_counts": "WITH " + ORDERS + """ e AS (SELECT 1) SELECT NULL::VARCHAR AS version, (SELECT count(*) FROM orders) AS node_count, (SELECT count(*) FROM defs) AS entity_definition_count,
(SELECT count(*) FROM part) AS identity_count, 0::BIGINT AS entity_relationship_count""",
        "measured_keys": keys,
        "measured_containment": contained,
    }


def normalized(value: str) -> str:
    """The normalisation rule for text of ASCII and composed Latin-1 letters."""
    split = rf"regexp_replace(regexp_replace({value}, '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), '([a-z0-9])([A-Z])', '\1 \2', 'g')"
    return rf"trim(regexp_replace(replace(lower({split}), 'ß', 'ss'), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


def _search() -> dict[str, str]:
    docs = f"SELECT doc_id, {normalized('text')} AS n FROM documents"
    corpus = f"""
li AS (SELECT l_suppkey, l_linenumber AS k, 'supplier:' || l_suppkey AS node_id, 'line_' || l_linenumber AS col, 'part:' || min(l_partkey) AS part,
  max(l_returnflag) AS flag, min(l_linestatus) AS status, count(*) AS n FROM lineitem GROUP BY l_suppkey, l_linenumber),
rel AS (SELECT a.part AS l, b.part AS r, count(*) AS n, row_number() OVER (ORDER BY a.part, b.part) AS ord
  FROM li a JOIN li b ON a.l_suppkey = b.l_suppkey AND a.k = 1 AND b.k = 2 AND a.part <> b.part GROUP BY a.part, b.part),
raw AS (
  SELECT 'column' AS kind, 'C' || ord AS key, ord, col AS label, unnest([{{'f': 2, 'v': col}},
    {{'f': 11, 'v': CASE flag WHEN 'A' THEN 'accepted line' WHEN 'R' THEN 'returned line' END}}, {{'f': 12, 'v': CASE status WHEN 'F' THEN 'finished ' || n END}},
    {{'f': 4, 'v': 'itemNo' || k}}]) AS e, generate_subscripts([1, 2, 3, 4], 1) AS i FROM (SELECT *, row_number() OVER (ORDER BY node_id, col) AS ord FROM li)
  UNION ALL SELECT 'entity_definition', 'D' || ord, ord, CASE flag WHEN 'R' THEN 'lower(' || col || ')' ELSE part END, unnest([
    {{'f': 1, 'v': part}}, {{'f': 8, 'v': col}}, {{'f': 9, 'v': CASE flag WHEN 'R' THEN 'lower(' || col || ')' END}}, {{'f': 10, 'v': CASE status WHEN 'F' THEN 'flag' END}},
    {{'f': 10, 'v': CASE status WHEN 'F' THEN 'worst' END}}, {{'f': 10, 'v': CASE status WHEN 'F' THEN flag END}}, {{'f': 10, 'v': CASE status WHEN 'F' THEN 'seen' END}},
    {{'f': 10, 'v': CASE status WHEN 'F' THEN 'lineFlag' END}}, {{'f': 10, 'v': CASE status WHEN 'F' THEN status END}}, {{'f': 10, 'v': CASE status WHEN 'F' THEN 'rows' END}}]),
    generate_subscripts([1, 2, 3, 4, 5, 6, 7, 8, 9, 10], 1) FROM (SELECT *, row_number() OVER (ORDER BY node_id, part, col) AS ord FROM li)
  UNION ALL SELECT 'entity_relationship', 'X' || ord, ord, l || ' ' || r, {{'f': 11, 'v': 'sold together by ' || n}}, 1 FROM rel
  UNION ALL SELECT 'identity' AS kind, 'doc:' || doc_id AS key, NULL, lang || ' ' || source AS label, unnest([
    {{'f': 1, 'v': 'doc:' || doc_id}}, {{'f': 3, 'v': lang || ' ' || source}}, {{'f': 11, 'v': text}}, {{'f': 4, 'v': lang}}, {{'f': 4, 'v': source}}]) AS e,
    generate_subscripts([1, 2, 3, 4, 5], 1) AS i FROM documents
  UNION ALL SELECT 'identity', 'part:' || p_partkey, NULL, p_name, unnest([
    {{'f': 1, 'v': 'part:' || p_partkey}}, {{'f': 3, 'v': p_name}}, {{'f': 11, 'v': p_type}}, {{'f': 4, 'v': p_brand}}]), generate_subscripts([1, 2, 3, 4], 1) FROM part
  UNION ALL SELECT 'dataset', 'supplier:' || s_suppkey, NULL, s_name, unnest([
    {{'f': 1, 'v': 'supplier:' || s_suppkey}}, {{'f': 3, 'v': s_name}}, {{'f': 6, 'v': n_name || '.' || s_name}},
    {{'f': 11, 'v': CASE WHEN s_acctbal < 0 THEN NULL ELSE 'active supplier' END}}, {{'f': 4, 'v': n_name}}, {{'f': 7, 'v': 'table'}}, {{'f': 7, 'v': 'supplier'}}]),
    generate_subscripts([1, 2, 3, 4, 5, 6, 7], 1) FROM supplier JOIN nation ON s_nationkey = n_nationkey),
nrm AS (SELECT kind, key, ord, {normalized('label')} AS sort_label, e.f AS field, e.v AS value, i, {normalized('e.v')} AS normalized FROM raw),
vals AS (SELECT *, row_number() OVER (PARTITION BY kind, key ORDER BY i) - 1 AS value_idx FROM nrm WHERE normalized <> '')"""
    queries = f"""
qs AS (SELECT DISTINCT query, {normalized('query')} AS q FROM (
  SELECT p_name AS query FROM part UNION ALL SELECT array_to_string(list_reverse(string_split(p_name, ' ')), ' ') FROM part
  UNION ALL SELECT n_name || ' supplier' FROM nation UNION ALL SELECT 'supplier ' || n_name FROM nation UNION ALL SELECT left(p_name, 3) FROM part
  UNION ALL SELECT unnest(['line_' || l_linenumber, 'itemNo' || l_linenumber, 'Lower(line_' || l_linenumber || ')', 'sold together by ' || l_linenumber, 'worst ' || l_returnflag,
    l_returnflag, 'accepted', 'finished', '--', '']) FROM (SELECT DISTINCT l_linenumber, l_returnflag FROM lineitem))),
terms AS (SELECT DISTINCT kind, key, value_idx, unnest(list_append(string_split(normalized, ' '), normalized)) AS term FROM vals),
whole AS (SELECT query, kind, key, value_idx, CASE WHEN term = q THEN 0 ELSE 1 END AS rank, term FROM qs JOIN terms ON starts_with(term, q) WHERE q <> ''),
cand AS (SELECT query, q, kind, key, value_idx, string_split(q, ' ') AS w, string_split(normalized, ' ') AS h FROM qs, vals
  WHERE contains(q, ' ') AND ((kind = 'dataset' AND field IN (3, 6)) OR (kind = 'identity' AND field = 3))),
hits AS (SELECT *, list_filter(range(1, len(h) - len(w) + 2), lambda s: len(list_filter(range(1, len(w) + 1), lambda j: starts_with(h[s + j - 1], w[j]))) = len(w)) AS runs
  FROM cand WHERE len(list_filter(w, lambda x: len(list_filter(h, lambda y: starts_with(y, x))) > 0)) = len(w)),
words AS (SELECT query, kind, key, value_idx, CASE WHEN len(runs) > 0 THEN 2 ELSE 3 END AS rank,
  CASE WHEN len(runs) > 0 THEN array_to_string(h[runs[1]:runs[1] + len(w) - 1], ' ') ELSE array_to_string(list_transform(w, lambda x: list_filter(h, lambda y: starts_with(y, x))[1]), ' ') END AS term FROM hits),
best AS (SELECT query, kind, key, value_idx, first(rank ORDER BY rank, term) AS rank, first(term ORDER BY rank, term) AS term FROM (SELECT * FROM whole UNION ALL SELECT * FROM words) GROUP BY ALL),
full_ AS (SELECT b.*, v.ord, v.field, v.value, v.sort_label FROM best b JOIN vals v USING (kind, key, value_idx)),
subj AS (SELECT query, kind, key, row_number() OVER (PARTITION BY query, kind ORDER BY min(rank), sort_label, ord, key) AS srank, count(*) OVER (PARTITION BY query, kind) AS total FROM full_ GROUP BY query, kind, key, ord, sort_label)"""
    return {
        "normalized_documents": f"SELECT doc_id, md5(n) AS digest, length(n) AS length FROM ({docs})",
        "term_frequencies": f"SELECT md5(term) AS term, count(*) AS document_count FROM (SELECT DISTINCT doc_id, unnest(list_append(string_split(n, ' '), n)) AS term FROM ({docs}) WHERE n <> '') GROUP BY term",
        "search_corpus": "WITH " + corpus + " SELECT kind, key, field, value_idx, md5(normalized) AS digest FROM vals",
        "lexical_search": "WITH " + corpus + ", " + queries + """
SELECT f.query AS query_id, f.kind, f.key, srank AS rank, row_number() OVER (PARTITION BY f.query, f.kind, f.key ORDER BY f.rank, field, value_idx) AS match_rank,
  ['exact', 'prefix', 'phrase', 'all_words'][f.rank + 1] AS match_type,
  CASE field WHEN 1 THEN CASE f.kind WHEN 'dataset' THEN 'node_id' ELSE 'identity_id' END WHEN 3 THEN CASE f.kind WHEN 'dataset' THEN 'display_name' ELSE 'name' END
    WHEN 2 THEN 'column_name' WHEN 4 THEN 'synonym' WHEN 6 THEN 'qualified_name' WHEN 7 THEN 'accessor' WHEN 8 THEN 'dataset_columns' WHEN 9 THEN 'entity_expression'
    WHEN 10 THEN 'entity_metadata' WHEN 11 THEN 'description' WHEN 12 THEN 'value_description' END AS match_field,
  md5(term) AS matched_term, md5(value) AS matched_value, total, total > 5 AS truncated
FROM full_ f JOIN subj s USING (query, kind, key) WHERE srank <= 5""",
    }


def _documents() -> dict[str, str]:
    num = "cast(substr({n}, 7) AS BIGINT)"
    prelude = ORDER_PEERS + f""", e AS MATERIALIZED (SELECT a.node_id, {num.format(n='a.node_id')} AS doc_id, a.identity_id, a.col, a.ord AS s_ord, b.ord AS t_ord, b.node_id AS t_node,
  (b.ord - a.ord) % 7 = 0 AS broken, {mult('a', 'b')} AS multiplicity, {exist('a', 'b')} AS existence,
  '$.datasets[''' || a.node_id || '''].edge_groups[''' || a.identity_id || '''].entity_definitions[[''' || a.col || ''']].edges[''' ||
  CASE WHEN (b.ord - a.ord) % 7 = 0 THEN 'D' || b.ord || '-D' || a.ord ELSE 'D' || a.ord || '-D' || b.ord END || ''']' AS loc
  FROM pr WHERE b IS NOT NULL)"""
    sentence = """CASE WHEN existence = 'always' THEN 'Every ' ELSE 'Each ' END || lft || ' row matches ' ||
  CASE WHEN multiplicity IN ('1:1', 'many:1') THEN CASE WHEN existence = 'always' THEN 'exactly one ' ELSE 'at most one ' END || rgt || ' row'
       WHEN multiplicity IN ('1:many', 'many:many') THEN CASE WHEN existence = 'always' THEN 'one or more ' ELSE 'any number of ' END || rgt || ' rows'
       ELSE 'an unknown number of ' || rgt || ' rows' END ||
  CASE existence WHEN 'always' THEN '.' WHEN 'optional' THEN '; some match none.' ELSE '; whether every ' || lft || ' row matches is unknown.' END"""
    return {
        # Every sixth document lacks its qualified name and reports only that.
        "document_findings": prelude + """
SELECT o_orderkey AS doc_id, '$.datasets[0].qualified_name' AS location, 'missing' AS rule, 'error' AS severity FROM orders WHERE o_orderkey % 6 = 0
UNION ALL SELECT o_orderkey, '$.datasets[0].rows', 'unknown_key', 'info' FROM orders WHERE o_orderkey % 6 <> 0 AND o_orderkey % 9 = 0
UNION ALL SELECT doc_id, loc, 'edge_key', 'error' FROM e WHERE broken AND doc_id % 6 <> 0
UNION ALL SELECT doc_id, loc || '.edge', 'dangling_reference', 'warning' FROM e WHERE t_node <> node_id AND doc_id % 6 <> 0""",
        "document_differences": prelude + """
SELECT doc_id, loc AS location, 'unknown_element' AS rule, 'error' AS severity FROM e WHERE broken
UNION ALL SELECT o_orderkey, '$.datasets[''order:' || o_orderkey || '''].descriptor.description', 'graph_mismatch', 'error' FROM orders WHERE o_orderkey % 4 = 0""",
        "document_sentences": prelude + f"""
SELECT doc_id, CASE WHEN broken THEN 'D' || t_ord || '-D' || s_ord ELSE 'D' || s_ord || '-D' || t_ord END AS edge_id, {sentence} AS forward
FROM (SELECT *, CASE WHEN doc_id % 6 = 0 THEN NULL ELSE cast(doc_id AS VARCHAR) END AS lft, CASE WHEN t_node = node_id THEN cast(doc_id AS VARCHAR) ELSE t_node END AS rgt FROM e)""",
    }


#: (table, columns, entity): the definitions that are measured together.
MEASURED = (
    ("lineitem", "l_orderkey", "order"), ("orders", "o_orderkey", "order"), ("orders", "o_custkey", "customer"), ("customer", "c_custkey", "customer"),
    ("lineitem", "l_partkey", "part"), ("part", "p_partkey", "part"), ("lineitem", "l_suppkey", "supplier"), ("supplier", "s_suppkey", "supplier"),
    ("customer", "c_nationkey", "nation"), ("supplier", "s_nationkey", "nation"), ("nation", "n_nationkey", "nation"), ("nation", "n_regionkey", "region"),
    ("region", "r_regionkey", "region"), ("documents", "doc_id", "document"), ("labels", "doc_id", "document"), ("benchmark", "item_id", "item"),
    ("lineitem", "l_orderkey,l_linenumber", "line"), ("conversations", "conv_id,turn", "turn"), ("events", "user_id,event_type", "action"),
    ("events", "user_id", "user"), ("embeddings", "vec_id", "vector"), ("pages", "page_id", "page"), ("part", "p_name", "name"),
)


def _measures() -> dict[str, str]:
    def keys(columns: str) -> str:
        return ", ".join(f"{c} AS k{i}" for i, c in enumerate(columns.split(",")))

    def whole(columns: str) -> str:
        return " AND ".join(f"{c} IS NOT NULL" for c in columns.split(","))

    def sides(a: tuple, b: tuple, what: str) -> str:
        x, y = (f"(SELECT DISTINCT {keys(c)} FROM {t} WHERE {whole(c)})" for t, c, _ in (a, b))
        return f"(SELECT count(*) FROM ({x} {what} {y}))"

    each = " UNION ALL ".join(f"""SELECT '{t}:{c}' AS definition, '{e}' AS entity, count(*) AS record_count,
  count(DISTINCT CASE WHEN {whole(c)} THEN row({c}) END) AS key_count, count(*) FILTER (NOT ({whole(c)})) AS null_count,
  count(DISTINCT CASE WHEN {whole(c)} THEN row({c}) END) = count(*) FILTER ({whole(c)}) AS "unique", count(*) FILTER (NOT ({whole(c)})) = 0 AS total FROM {t}"""
                             for t, c, e in MEASURED)
    pairs = " UNION ALL ".join(f"""SELECT '{a[2]}' AS entity, '{a[0]}:{a[1]}' AS "left", '{b[0]}:{b[1]}' AS "right", {sides(a, b, 'INTERSECT')} AS shared_count,
  {sides(a, b, 'EXCEPT')} AS left_only_count, {sides(b, a, 'EXCEPT')} AS right_only_count"""
                              for i, a in enumerate(MEASURED) for b in MEASURED[i + 1 :] if a[2] == b[2])
    return {
        "measured_definitions": each,
        "measured_pairs": f"""SELECT *, left_only_count = 0 AS left_conforms, right_only_count = 0 AS right_conforms,
  left_only_count + right_only_count > 0 AS conflict_if_complete FROM ({pairs})""",
    }


def _rules() -> dict[str, str]:
    """One branch per rule of the integrity checks."""
    base = """WITH c AS (SELECT c_custkey AS k, 'c:' || c_custkey AS node, 'nation:' || c_nationkey AS nation FROM customer),
i AS (SELECT n_nationkey AS n, 'nation:' || n_nationkey AS id FROM nation WHERE n_nationkey % 6 <> 0),
r AS (SELECT s_suppkey AS s, 'nation:' || s_nationkey AS l, CASE WHEN s_suppkey % 31 = 0 THEN ' ' ELSE 'nation:' || s_suppkey % 25 END AS r FROM supplier),
e AS (SELECT *, '[''' || l || ''', ''' || r || ''']' AS ends FROM r),
own AS (SELECT min(node) AS node FROM c WHERE k % 11 = 0)
"""
    rows = [
        ("duplicate_identity", "NULL", "id", "'identity_id values must be unique'", "i WHERE n % 4 = 1"),
        ("duplicate_accessor", "c.node", "NULL", "'datasets ''' || own.node || ''' and ''' || c.node || ''' have the same accessor kind, endpoint, and properties'",
         "c, own WHERE k % 11 = 0 AND c.node > own.node"),
        ("duplicate_column", "node", "NULL", "'column ''id'' is listed more than once'", "c WHERE k % 7 = 0"),
        ("missing_column", "node", "nation", "'entity definition ''' || nation || ''' uses missing columns: [''a'', ''b'']'", "c WHERE k % 5 = 1"),
        ("duplicate_definition", "node", "nation", "'entity definition on [''id''] is listed more than once'", "c WHERE k % 5 = 2"),
        ("column_list", "node", "nation", "'entity definition dataset_columns contains duplicates'", "c WHERE k % 5 = 0"),
        ("column_list", "node", "nation", "'entity definition dataset_columns is not in ascending order'", "c WHERE k % 5 = 1"),
        ("column_list", "node", "NULL", "'grain dataset_columns is empty'", "c WHERE k % 13 = 2"),
        ("unknown_identity", "node", "nation", "'node ' || node || ' references unknown logical entity ' || nation", "c WHERE nation NOT IN (SELECT id FROM i)"),
        ("grain_column", "node", "NULL", "'grain uses missing column ''gone'''", "c WHERE k % 13 = 0"),
        ("grain_definition", "node", "'nation:x'", "'grain component does not resolve to an entity definition: ''nation:x'', [''id'']'", "c WHERE k % 13 = 1"),
        ("complete_must_conform", "node", "nation", "'a complete entity definition conforms by definition'",
         "c, range(1, 3) t(x) WHERE k % 23 = 0 AND k % 19 <> 0 AND (x = 1 OR k % 5 = 2)"),
        ("claim_domain", "node", "nation", "'entity_universe must be one of complete, partial, unknown'", "c, range(1, 3) t(x) WHERE k % 19 = 0 AND (x = 1 OR k % 5 = 2)"),
        ("blank", "node", "nation", "'entity_expression must not be blank'", "c, range(1, 3) t(x) WHERE k % 29 = 0 AND (x = 1 OR k % 5 = 2)"),
        ("blank", "node", "NULL", "'qualified_name must not be blank'", "c WHERE k % 17 = 0"),
        ("blank", "NULL", "id", "'name must not be blank'", "i, range(1, 3) t(x) WHERE n % 5 = 0 AND (x = 1 OR n % 4 = 1)"),
        ("endpoints", "NULL", "l", "'endpoints must not be blank: ' || ends", "e WHERE r = ' '"),
        ("endpoints", "NULL", "l", "'endpoints must be in ascending lexical order: ' || ends", "e WHERE l > r"),
        ("claim_domain", "NULL", "l", "'multiplicity must be one of 1:1, 1:many, many:1, many:many, unknown'", "e WHERE s % 4 = 0"),
        ("claim_domain", "NULL", "l", "'me_right must be one of always, optional, unknown'", "e WHERE s % 9 = 0"),
        ("descriptions", "NULL", "l", "'descriptions must not be empty'", "e WHERE s % 3 = 0"),
        ("descriptions", "NULL", "l", "'descriptions must not be blank'", "e WHERE s % 3 = 1"),
        ("descriptions", "NULL", "l", "'descriptions must be distinct'", "e WHERE s % 3 = 2 AND s % 8 = 2"),
        ("duplicate_pair", "NULL", "l", "'cross-entity relationship ' || ends || ' is listed more than once'", "(SELECT l, r, ends FROM e GROUP BY ALL HAVING count(*) > 1)"),
        ("unknown_identity", "NULL", "l",
         "'cross-entity relationship ' || ends || ' references unknown logical entities [' || array_to_string(list_transform(u, lambda x: '''' || x || ''''), ', ') || ']'",
         "(SELECT DISTINCT l, ends, list_filter(list_sort(list_distinct([l, r])), lambda x: NOT list_contains(ids, x)) AS u FROM e, (SELECT list(id) AS ids FROM i)) WHERE len(u) > 0"),
        ("duplicate_annotation", "NULL", "NULL", "'annotation edge_id E' || k || ' is listed more than once'", "c WHERE k % 100 = 0"),
        ("unknown_edge", "NULL", "NULL", "'annotation references unknown edge E' || k", "c WHERE k % 50 = 0"),
    ]
    return {"integrity_rules": base + " UNION ALL ".join(
        f"SELECT '{rule}' AS rule, {node} AS node_id, {entity} AS identity_id, {message} AS message FROM {source}" for rule, node, entity, message, source in rows)}


def _statuses() -> dict[str, str]:
    requests = ", " + LARGEST + ", best AS (" + largest("c_custkey") + """)
, req AS (SELECT req_id, CASE WHEN req_id % 4 = 0 THEN 'order:none' ELSE node_id END AS node_id,
  CASE WHEN req_id % 4 = 1 THEN 'part:none' ELSE 'part:' || p END AS identity_id
  FROM best LEFT JOIN (SELECT 'order:' || l_orderkey AS node_id, min(l_partkey) AS p FROM lineitem GROUP BY l_orderkey) USING (node_id))"""
    files = """WITH f AS (SELECT c_custkey AS k, c_custkey % 5 AS kind, 'c' || c_custkey || '.yaml' AS path FROM customer),
s AS (SELECT * FROM f WHERE k % 7 <> 0), first_ AS (SELECT k, path FROM s WHERE kind = 4 ORDER BY k LIMIT 1)
"""
    return {
        "edge_sources": ORDER_MEMBERS + requests + "SELECT req_id, ord AS s_ord, node_id AS s_node_id, identity_id AS s_identity_id FROM req JOIN m USING (node_id, identity_id)",
        "edge_statuses": ORDER_MEMBERS + requests + """
SELECT req_id, CASE WHEN req_id % 4 = 0 THEN 'unknown_dataset' WHEN req_id % 4 = 2 THEN 'unknown_identity'
  WHEN identity_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM m WHERE m.node_id = req.node_id AND m.identity_id = req.identity_id) THEN 'no_definition' ELSE 'ok' END AS status FROM req""",
        "ownership_findings": files + """SELECT path || ':$' AS location, 'yaml_syntax' AS rule, 'broken' AS message FROM f WHERE k % 7 = 0
UNION ALL SELECT path || ':$', 'missing', 'collection file must contain nodes' FROM s WHERE kind = 1
UNION ALL SELECT path || ':$.schema_version', 'conflicting_schema_version', 'schema_version conflicts with the manifest: 2' FROM s WHERE kind = 2
UNION ALL SELECT path || ':$.logical_identities', 'collection_ownership', 'file is owned by nodes, not logical_identities' FROM s WHERE kind = 3
UNION ALL SELECT s.path || ':$.nodes[0].node_id', 'duplicate_definition', 'already defined in ' || first_.path FROM s, first_ WHERE kind = 4 AND s.k > first_.k""",
        "fingerprint_changes": """SELECT table_name, false AS layout_changes, table_name = 'definitions' AS row_changes
FROM (SELECT unnest(['identities', 'datasets', 'columns', 'definitions', 'entity_relationships', 'annotations']) AS table_name)""",
        "search_subjects": """WITH li AS (SELECT 'supplier:' || l_suppkey AS node_id, 'part:' || min(l_partkey) AS identity_id, 'line_' || l_linenumber AS dataset_columns, max(l_returnflag) AS flag
  FROM lineitem GROUP BY l_suppkey, l_linenumber)
SELECT 'D' || row_number() OVER (ORDER BY node_id, identity_id, dataset_columns) AS key, CASE flag WHEN 'R' THEN 'lower(' || dataset_columns || ')' END AS entity_expression,
  node_id, identity_id, dataset_columns, 'conforms|entity_universe|total|unique' AS unknown_fields FROM li""",
    }


def all_sql() -> dict[str, str]:
    return {**_measures(), **_rules(), **_statuses(), **_sources(), **_relationships(), **_discovery(), **_traversal(), **_checks(), **_search(), **_documents()}
