"""Graph build, views, searches, traversals, snapshots of graphs and contracts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from factloom.functions import norm as N
from factloom.operators import graph as G
from factloom.operators import predicates as P
from factloom.operators import resolve as S
from factloom.operators import traverse as T
from factloom.operators.shredding import flow_nodes
from factloom.plans import base as B
from factloom.plans.aggregates import EDGES, edges
from factloom.plans.base import CALLS, FACTS, LINKS, ORACLE, QUERIES, QUEUE_ROLES, RESOURCE_OPS, SERVICES, query, with_  # noqa: F401
from factloom.plans.joins import _HOST, _RT, _STEPS, _steps
from factloom.session import cut
from factloom.sources.tables import table

_QK = r"regexp_replace(lower(trim(regexp_extract(name, '^\S+\s+(.*)$', 1))), '[^a-z0-9]', '', 'g')"
_GE = rf"""te AS (
  SELECT 'service:' || f.service AS src, 'service:' || m.to_service AS dst, 'http' AS edge_type, f.entity_id AS fact_id, least(f.confidence, m.c) AS confidence FROM facts f JOIN (SELECT entity_id, to_service, 0.92 AS c FROM exact UNION ALL SELECT entity_id, to_service, 0.84 FROM stripped) m USING (entity_id)
  UNION ALL SELECT 'service:' || service, 'external:' || {_HOST.format(c='host')}, 'external', entity_id, confidence FROM facts WHERE type = 'outbound_http' AND coalesce(host, '') <> '' AND entity_id NOT IN (SELECT entity_id FROM exact UNION ALL SELECT entity_id FROM stripped)
  UNION ALL SELECT 'service:' || service, 'db:' || coalesce(nullif(trim(lower(db_name)), ''), nullif(trim(lower(d_table)), ''), nullif(trim(lower(instance)), ''), ''), 'database', entity_id, confidence FROM facts WHERE type = 'db_operation'
  UNION ALL SELECT 'service:' || service, 'cache:' || service, 'cache', entity_id, confidence FROM facts WHERE type = 'cache_operation'
  UNION ALL SELECT 'service:' || service, 'queue:' || {_QK}, 'queue_publish', entity_id, confidence FROM facts WHERE type = 'queue_publish'
  UNION ALL SELECT 'queue:' || {_QK}, 'service:' || service, 'queue_consume', entity_id, confidence FROM facts WHERE type IN ('queue_consumer', 'stream_consume')
  UNION ALL SELECT 'sched:' || regexp_replace(lower(name), '[^a-z0-9_-]', '_', 'g'), 'service:' || service, 'scheduler', entity_id, confidence FROM facts WHERE type = 'scheduled_job'),
ge AS (SELECT src, dst, edge_type, count(*) AS facts, CASE WHEN edge_type IN ('database', 'cache') THEN 0.0 ELSE round(coalesce(min(CASE WHEN confidence > 0 THEN confidence END), 0.0), 6) END AS confidence FROM te GROUP BY src, dst, edge_type),
gn AS (SELECT DISTINCT node, split_part(node, ':', 1) AS node_kind FROM (SELECT 'service:' || service AS node FROM facts UNION ALL SELECT src FROM ge UNION ALL SELECT dst FROM ge))"""
#: Methods that a repository reads or writes by; fixed values.
STORE_VERBS = r"(?i)\.(find|get|read|load|list|fetch|query|search|count|exists|select|save|insert|update|delete|remove|write|create|upsert|persist|put|merge)[A-Za-z0-9]*$"
_GRAPH = with_(FACTS, _RT, _GE)


def graph_edges(spark, d):
    return G.aggregated(G.typed_edges(B.facts(spark, d)))


@query(_GRAPH + "SELECT * FROM ge")
def g1_graph_edges(spark, d):
    return graph_edges(spark, d)


@query(_GRAPH + "SELECT * FROM gn")
def g1_graph_nodes(spark, d):
    return G.nodes(B.facts(spark, d), graph_edges(spark, d))


@query(_GRAPH + "SELECT node_kind, count(*) AS nodes FROM gn GROUP BY node_kind")
def g2_overview(spark, d):
    return G.nodes(B.facts(spark, d), graph_edges(spark, d)).groupBy("node_kind").agg(F.count("*").alias("nodes"))


@query(_GRAPH + "SELECT 'service:edge-gateway' AS node, CASE WHEN src = 'service:edge-gateway' THEN 'outbound' ELSE 'inbound' END AS direction, edge_type, CASE WHEN src = 'service:edge-gateway' THEN dst ELSE src END AS other, facts FROM ge WHERE src = 'service:edge-gateway' OR dst = 'service:edge-gateway'")
def g3_neighbourhood(spark, d, node="service:edge-gateway"):
    e = graph_edges(spark, d).where((F.col("src") == node) | (F.col("dst") == node))
    out = F.col("src") == node
    return e.select(F.lit(node).alias("node"), F.when(out, "outbound").otherwise("inbound").alias("direction"), "edge_type", F.when(out, F.col("dst")).otherwise(F.col("src")).alias("other"), "facts")


@query(_GRAPH + "SELECT replace(src, 'service:', '') AS service, 'outbound' AS direction, edge_type, dst AS other, split_part(dst, ':', 1) AS other_kind, facts, confidence FROM ge WHERE prefix(src, 'service:') UNION ALL SELECT replace(dst, 'service:', ''), 'inbound', edge_type, src, split_part(src, ':', 1), facts, confidence FROM ge WHERE prefix(dst, 'service:')")
def g4_service_views(spark, d):
    """The view of every service: its edges out and in, what is at the other end, and their weight; one pass over the edges."""
    side = lambda own, other, way: F.when(F.startswith(own, F.lit("service:")), F.struct(F.regexp_replace(own, "^service:", "").alias("service"), F.lit(way).alias("direction"), F.col(other).alias("other")))
    e = graph_edges(spark, d).select("edge_type", "facts", "confidence", F.explode(F.array_compact(F.array(side("src", "dst", "outbound"), side("dst", "src", "inbound")))).alias("v"))
    return e.select("v.service", "v.direction", "edge_type", "v.other", F.split_part("v.other", F.lit(":"), F.lit(1)).alias("other_kind"), "facts", "confidence")


@query(with_(CALLS, EDGES, SERVICES) + """, t AS (SELECT service_id FROM services WHERE lower(team) = 'nation_3'), vis AS (SELECT service_id FROM t UNION SELECT dst FROM edges WHERE src IN (SELECT service_id FROM t) UNION SELECT src FROM edges WHERE dst IN (SELECT service_id FROM t))
SELECT src, dst, edge_type, src IN (SELECT service_id FROM t) AND dst IN (SELECT service_id FROM t) AS inside FROM edges WHERE src IN (SELECT service_id FROM vis) AND dst IN (SELECT service_id FROM vis)""")
def g5_team_view(spark, d, team="nation_3"):
    """Edges between a team's services and those one hop away."""
    e = edges(spark, d).select("src", "dst", "edge_type")
    t = B.services(spark, d).where(F.lower("team") == team).select("service_id")
    near = e.join(t, e.src == t.service_id, "left_semi").select("dst").union(e.join(t, e.dst == t.service_id, "left_semi").select("src")).union(t).toDF("n").distinct()
    vis = e.join(near.toDF("src"), "src", "left_semi").join(near.toDF("dst"), "dst", "left_semi")
    a, b = t.toDF("src").withColumn("ia", F.lit(True)), t.toDF("dst").withColumn("ib", F.lit(True))
    return vis.join(a, "src", "left").join(b, "dst", "left").select("src", "dst", "edge_type", (F.col("ia").isNotNull() & F.col("ib").isNotNull()).alias("inside"))


@query(with_(RESOURCE_OPS) + "SELECT resource_name, category, service_id, count(DISTINCT table_name) AS tables, count(*) FILTER (WHERE operation = 'read') AS reads, count(*) FILTER (WHERE operation = 'write') AS writes, count(*) OVER (PARTITION BY resource_name, category) > 1 AS shared FROM resource_ops GROUP BY resource_name, category, service_id")
def g6_resource_views(spark, d):
    """The view of every resource: which services use it, how, and whether it is shared."""
    k = ["resource_name", "category"]
    v = B.resource_ops(spark, d).groupBy(*k, "service_id").agg(F.countDistinct("table_name").alias("tables"), F.count_if(F.col("operation") == "read").alias("reads"), F.count_if(F.col("operation") == "write").alias("writes"))
    n = v.groupBy(k).agg((F.count("*") > 1).alias("shared"))
    return v.join(n, k)


_LOOKUP = r"trim(regexp_replace(regexp_replace(replace(lower(f.name), '_', '-'), '[^a-z0-9/{}.:-]+', ' ', 'g'), '\s+', ' ', 'g'))"


@query(with_(FACTS, LINKS) + f", hit AS (SELECT entity_id FROM facts f WHERE contains({_LOOKUP}, 'order')) SELECT h.entity_id, l.connection_id, 'outbound' AS direction, l.dst AS other, l.status FROM hit h JOIN links l ON l.src = h.entity_id UNION ALL SELECT h.entity_id, l.connection_id, 'inbound', l.src, l.status FROM hit h JOIN links l ON l.dst = h.entity_id")
def g7_trace_view(spark, d, text="order"):
    """Connections of all objects whose normalized name holds a text: what they lead to, and what leads to them."""
    hit = B.facts(spark, d).where(F.contains(N.lookup("name"), F.lit(text))).select("entity_id")
    l = B.links(spark, d).select("connection_id", "src", "dst", "status")  # noqa: E741
    ends = l.select("connection_id", "status", F.explode(F.array(F.struct(F.col("src").alias("entity_id"), F.lit("outbound").alias("direction"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("entity_id"), F.lit("inbound").alias("direction"), F.col("src").alias("other")))).alias("e"))
    return ends.select("connection_id", "status", "e.*").join(hit, "entity_id").select("entity_id", "connection_id", "direction", "other", "status")


@query(with_(FACTS, LINKS) + "SELECT entity_id, count(*) AS connections, count(*) FILTER (WHERE n <= 5) AS shown, string_agg(connection_id, ',' ORDER BY connection_id) FILTER (WHERE n <= 5) AS first_ids FROM (SELECT f.entity_id, l.connection_id, row_number() OVER (PARTITION BY f.entity_id ORDER BY l.connection_id) AS n FROM facts f JOIN links l ON l.src = f.entity_id) GROUP BY entity_id")
def g8_object_trace(spark, d, shown=5):
    """Connections of each exact object: full count, and the first few in order."""
    f = B.facts(spark, d).select("entity_id")
    j = f.join(B.links(spark, d).select(F.col("src").alias("entity_id"), "connection_id"), "entity_id")
    total = j.groupBy("entity_id").agg(F.count("*").alias("connections"))
    # the filter on the rank lets each task keep only the first few before the shuffle
    first = j.withColumn("n", F.row_number().over(Window.partitionBy("entity_id").orderBy("connection_id"))).where(F.col("n") <= shown)
    ids = first.groupBy("entity_id").agg(F.count("*").alias("shown"), F.array_join(F.array_sort(F.collect_list("connection_id")), ",").alias("first_ids"))
    return total.join(ids, "entity_id").select("entity_id", "connections", "shown", "first_ids")


_WALK = """walk AS (SELECT '0' AS node, ['0'] AS path, 0 AS depth UNION ALL SELECT CAST(e.dst AS VARCHAR), list_append(w.path, CAST(e.dst AS VARCHAR)), w.depth + 1 FROM walk w JOIN (SELECT DISTINCT src, dst FROM edges) e ON CAST(e.src AS VARCHAR) = w.node WHERE w.depth < 6 AND NOT list_contains(w.path, CAST(e.dst AS VARCHAR))),
reach AS (SELECT node, depth, min(path) AS path FROM walk JOIN (SELECT node, min(depth) AS depth FROM walk GROUP BY node) USING (node, depth) GROUP BY ALL)"""


@query(with_(CALLS, EDGES, SERVICES, _WALK) + "SELECT CAST(s.service_id AS VARCHAR) AS target, CASE WHEN r.path IS NULL THEN 'not_found' ELSE 'found' END AS status, r.depth, array_to_string(r.path, '>') AS path FROM services s LEFT JOIN reach r ON r.node = CAST(s.service_id AS VARCHAR)")
def g9_shortest_path(spark, d, start="0", depth=6):
    """Shortest path from one service to every service, ties by the smallest path."""
    return T.shortest_path(edges(spark, d), start, B.services(spark, d).select(F.col("service_id").alias("node")), depth)


_IMP = """mixed AS (SELECT 'service:' || src AS src, 'service:' || dst AS dst, edge_type FROM edges UNION SELECT 'service:' || service_id, 'queue:' || queue_key, 'queue_publish' FROM queue_roles WHERE role = 'publish'
  UNION SELECT 'queue:' || queue_key, 'service:' || service_id, 'queue_consume' FROM queue_roles WHERE role = 'consume' UNION SELECT 'service:' || service_id, 'db:' || resource_name, category FROM resource_ops WHERE category IN ('database', 'cache')),
imp AS (SELECT DISTINCT src AS a, dst AS b, edge_type FROM mixed WHERE edge_type IN ('queue_publish', 'queue_consume') UNION SELECT dst, src, edge_type FROM mixed WHERE edge_type IN ('http', 'rpc', 'workflow', 'database', 'cache'))"""


def impact(spark, d):
    e = edges(spark, d).select(F.concat(F.lit("service:"), "src").alias("src"), F.concat(F.lit("service:"), "dst").alias("dst"), "edge_type")
    q = B.queue_roles(spark, d)
    svc, queue = F.concat(F.lit("service:"), "service_id"), F.concat(F.lit("queue:"), "queue_key")
    pub, con = q.where("role = 'publish'").select(svc, queue, F.lit("queue_publish")), q.where("role = 'consume'").select(queue, svc, F.lit("queue_consume"))
    store = B.resource_ops(spark, d).where("category in ('database', 'cache')").select(svc, F.concat(F.lit("db:"), "resource_name"), "category")
    return G.impact_edges(e.union(pub).union(con).union(store))


@query(with_(CALLS, EDGES, QUEUE_ROLES, RESOURCE_OPS, _IMP) + """, r AS (SELECT 'service:0' AS node, 0 AS depth UNION SELECT i.b, r.depth + 1 FROM r JOIN imp i ON i.a = r.node WHERE r.depth < 7),
m AS (SELECT node, min(depth) AS depth FROM r GROUP BY node) SELECT node, CAST(depth AS INT) AS depth, prefix(node, 'service:') AS crosses_service, (SELECT max(depth) FROM m) > 6 AS bounded FROM m WHERE depth BETWEEN 1 AND 6""")
def g10_blast_radius(spark, d, target="service:0", depth=6):
    """What a change of one service affects; bounded says whether more lies beyond the depth."""
    return T.blast_radius(impact(spark, d), target, depth, nodes=None).select("node", "depth", "crosses_service", "bounded")


_TOPICS = r"""qt AS (SELECT *, regexp_replace(lower(trim(regexp_extract(name, '^\S+\s+(.*)$', 1))), '[-_.]+', '', 'g') AS topic FROM facts WHERE type IN ('queue_publish', 'queue_consumer', 'stream_consume')),
qm AS (SELECT entity_id, split_part(m, '|', 2) AS to_entity FROM (SELECT a.entity_id, min(b.service || '|' || b.entity_id) AS m FROM qt a JOIN qt b ON a.topic = b.topic AND a.topic <> '' AND a.type = 'queue_publish' AND b.type <> 'queue_publish' AND a.service <> b.service GROUP BY ALL)),
tr AS (SELECT src AS a, dst AS b FROM links WHERE src <> '' AND dst <> '' AND src <> dst UNION SELECT entity_id, to_entity FROM exact UNION SELECT entity_id, to_entity FROM stripped UNION SELECT entity_id, to_entity FROM qm)"""


@query(with_(FACTS, LINKS, _RT, _TOPICS) + """, w AS (SELECT entity_id AS root, entity_id AS node, 0 AS depth FROM facts WHERE kind = 'exposure' UNION SELECT w.root, tr.b, w.depth + 1 FROM w JOIN tr ON tr.a = w.node WHERE w.depth < 7),
m AS (SELECT root, node, min(depth) AS depth FROM w GROUP BY ALL) SELECT root, node, CAST(depth AS INT) AS depth, root IN (SELECT root FROM m WHERE depth = 7) AS limited FROM m WHERE depth BETWEEN 1 AND 6""")
def g11_flow_walk(spark, d, depth=6):
    """What each entry point sets off: its own connections, then the matched routes and queues of other services, up to a depth.

    States are facts; a state leads over its connections to dependencies, and from a dependency over a matched route or
    topic to another service's entry point. Cycles end where a state was seen; limited tells that more lies beyond the depth.
    """
    from factloom.operators.resolve import queue_matches, route_matches
    from factloom.session import cut

    f, l = cut(B.facts(spark, d)), B.links(spark, d)  # noqa: E741
    local = l.where("src <> '' and dst <> ''").select("src", "dst")
    cross = route_matches(f).select(F.col("entity_id").alias("src"), F.col("to_entity").alias("dst")).union(queue_matches(f).select("entity_id", "to_entity"))
    roots = f.where("kind = 'exposure'").select(F.col("entity_id").alias("root"))
    return T.levels(local.union(cross), roots, depth).where("depth > 0").select("root", "node", "depth", F.col("bounded").alias("limited"))


_TEXTS = "tx AS (SELECT unnest(['ticket', 'order', 'wallet', 'v2/']) AS t)"
TEXTS = ("ticket", "order", "wallet", "v2/")


@query(with_(FACTS, _TEXTS) + "SELECT t AS text, entity_id, name, service FROM (SELECT t, entity_id, name, service, row_number() OVER (PARTITION BY t ORDER BY service, name, entity_id) AS n FROM facts JOIN tx ON contains(lower(name), t) OR contains(service, t) WHERE kind = 'exposure') WHERE n <= 50")
def g12_entrypoint_search(spark, d, texts=TEXTS, cap=50):
    """Entry points whose name or service holds a text, the first ones of each text."""
    f = B.facts(spark, d).where("kind = 'exposure'").select("entity_id", "name", "service")
    fits = [F.when(F.contains(F.lower("name"), F.lit(t)) | F.contains("service", F.lit(t)), F.lit(t)) for t in texts]
    hits = f.withColumn("text", F.explode(F.array_compact(F.array(*fits))))
    return hits.withColumn("n", F.row_number().over(Window.partitionBy("text").orderBy("service", "name", "entity_id"))).where(F.col("n") <= cap).select("text", "entity_id", "name", "service")


@query(with_(FACTS, _TEXTS) + """SELECT DISTINCT t AS text, hit, id FROM (SELECT t, 'service' AS hit, service AS id FROM facts JOIN tx ON contains(service, t) UNION ALL SELECT t, type, entity_id FROM facts JOIN tx ON contains(lower(name), t) OR contains(lower(coalesce(details, '')), t)
UNION ALL SELECT t, 'resource', lower(trim(db_name)) FROM facts JOIN tx ON contains(lower(db_name), t) UNION ALL SELECT t, 'external', lower(trim(host)) FROM facts JOIN tx ON contains(lower(host), t))""")
def g13_full_search(spark, d, texts=TEXTS):
    """Services, objects (with their details), resources and external hosts that hold a text; one pass for all texts."""
    f = B.facts(spark, d).select("service", "type", "entity_id", "name", "details", "db_name", "host")
    has = lambda t, c: F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(t))
    hit = lambda on, t, kind, i: F.when(on, F.struct(F.lit(t).alias("text"), kind.alias("hit"), i.alias("id")))
    rows = [
        x for t in texts for x in (
            hit(has(t, "service"), t, F.lit("service"), F.col("service")), hit(has(t, "name") | has(t, "details"), t, F.col("type"), F.col("entity_id")),
            hit(has(t, "db_name"), t, F.lit("resource"), N.lower("db_name")), hit(has(t, "host"), t, F.lit("external"), N.lower("host")))
    ]
    return f.select(F.explode(F.array_compact(F.array(*rows))).alias("h")).select("h.*").distinct()


def _walk(spark, d, depth, total, per_symbol=None):
    s = _steps(spark, d)
    e = s.where("from_symbol is not null and to_symbol is not null").select(F.col("from_symbol").alias("src"), F.col("to_symbol").alias("dst"))
    entries = s.where("step_no = 1 and from_symbol is not null").select(F.col("from_symbol").alias("entry"))
    return T.call_walk(e, entries, depth, total, per_symbol).select("entry", F.array_join("path", ">").alias("path"), "hops", "truncated")


@query(with_(LINKS, _STEPS) + """, ed AS (SELECT DISTINCT from_symbol AS src, to_symbol AS dst FROM st WHERE from_symbol IS NOT NULL AND to_symbol IS NOT NULL), p AS (SELECT from_symbol AS entry, from_symbol AS node, [from_symbol] AS path, 0 AS hops FROM (SELECT DISTINCT from_symbol FROM st WHERE step_no = 1 AND from_symbol IS NOT NULL)
  UNION ALL SELECT p.entry, ed.dst, list_append(p.path, ed.dst), p.hops + 1 FROM p JOIN ed ON ed.src = p.node WHERE p.hops < 16 AND NOT list_contains(p.path, ed.dst)),
r AS (SELECT *, row_number() OVER (PARTITION BY entry ORDER BY hops, path) AS n, count(*) OVER (PARTITION BY entry) AS total, max(hops) OVER (PARTITION BY entry) AS most FROM p WHERE hops > 0)
SELECT entry, array_to_string(path, '>') AS path, CAST(hops AS INT) AS hops, total > 2000 OR most > 15 AS truncated FROM r WHERE hops <= 15 AND n <= 2000""")
def g14_call_paths(spark, d, depth=15, total=2000):
    """Call paths with the reference walker's depth and paths in total; truncated marks entries that have more."""
    return _walk(spark, d, depth, total)


@query()
def g15_symbol_walk(spark, d, depth=25, total=1000, per_symbol=3):
    """Call paths with the reference index walker's bounds: a few partial paths to each symbol an entry reaches.

    Implementations aren't followed.
    """
    return _walk(spark, d, depth, total, per_symbol)


@query(with_(LINKS) + r"""SELECT connection_id, regexp_extract(condition_expr, '^(\S+)', 1) AS field, regexp_extract(condition_expr, '(==|!=|<=|>=|<|>)', 1) AS operator, regexp_extract(condition_expr, '(?:==|!=|<=|>=|<|>)\s*(.*)$', 1) AS value,
  CASE WHEN regexp_matches(coalesce(condition_expr, ''), '(?i)\b(for|while|each)\b') THEN 'loop' WHEN len(paths) > 1 THEN 'fanout' ELSE 'once' END AS repetition FROM links""")
def g16_conditions(spark, d):
    l = B.links(spark, d)  # noqa: E741
    x = F.coalesce("condition_expr", F.lit(""))
    return l.select("connection_id", F.regexp_extract("condition_expr", r"^(\S+)", 1).alias("field"), F.regexp_extract("condition_expr", "(==|!=|<=|>=|<|>)", 1).alias("operator"), F.regexp_extract("condition_expr", r"(?:==|!=|<=|>=|<|>)\s*(.*)$", 1).alias("value"),
                    F.when(x.rlike(r"(?i)\b(for|while|each)\b"), "loop").when(F.size(F.coalesce("paths", F.array())) > 1, "fanout").otherwise("once").alias("repetition"))


@query()
def g17_connection_derivation(spark, d, depth=15):
    """Connections that call paths and containment derive: each entry point with every symbol it reaches and what stands there.

    An entry point's symbol is where its recorded paths begin, a dependency's where they end. A symbol that many dependencies
    share gives its first one and their number. Calls inside one class, and sources of tests and configuration, are left out.
    """
    steps = cut(_steps(spark, d))
    l = B.links(spark, d).select("connection_id", "src", "dst")  # noqa: E741
    f = B.facts(spark, d).select("entity_id", "kind", "file", "start_line", "end_line", "confidence")
    production = cut(f.where(~F.coalesce(F.col("file").rlike(P.TEST_LIKE) | F.col("file").rlike(P.CONFIG_LIKE), F.lit(False))))
    begins = steps.where("step_no = 1 and from_symbol is not null").select("connection_id", F.col("from_symbol").alias("entry"))
    last = steps.where("to_symbol is not null").groupBy("connection_id").agg(F.max_by("to_symbol", "step_no").alias("symbol"))
    exposures = l.join(begins, "connection_id").select(F.col("src").alias("entity_id"), "entry").join(production.where("kind = 'exposure'").select("entity_id"), "entity_id").distinct()
    ends = l.join(last, "connection_id").select(F.col("dst").alias("entity_id"), "symbol").join(production.where("kind = 'dependency'").select("entity_id"), "entity_id").groupBy("symbol").agg(F.min("entity_id").alias("dependency"), F.countDistinct("entity_id").alias("dependencies"))
    # the fewest calls to a symbol are all that is needed of its paths
    calls = steps.where("from_symbol is not null and to_symbol is not null").select(F.col("from_symbol").alias("src"), F.col("to_symbol").alias("dst"))
    owner = lambda c: F.split_part(c, F.lit("."), F.lit(1))
    starts = exposures.select(F.col("entity_id").alias("who"), F.col("entry").alias("root"), owner("entry").alias("owner"))
    paths = T.hops(calls, starts, ends.select(F.col("symbol").alias("node"), owner("symbol").alias("owner"), "dependency", "dependencies"), depth)
    score = F.round(F.greatest(F.least(F.lit(0.98) - F.lit(0.04) * (F.col("hops") - 1), F.lit(0.99)), F.lit(0.5)), 6)
    called = paths.select(F.col("who").alias("exposure"), F.col("node").alias("symbol"), "dependency", "dependencies", F.lit("call_path").alias("derived_by"), "hops", score.alias("confidence"))
    points = production.where("kind = 'dependency' and file is not null").select(F.col("entity_id").alias("point_id"), "file", F.col("start_line").alias("line"))
    ranges = production.where("kind = 'exposure' and file is not null").select(F.col("entity_id").alias("range_id"), "file", F.col("start_line").alias("lo"), F.col("end_line").alias("hi"))
    inside = S.containing(points, ranges, 0).select(F.col("range_id").alias("exposure"), F.lit(None).cast("string").alias("symbol"), F.col("point_id").alias("dependency"), F.lit(1).cast("bigint").alias("dependencies"), F.lit("containment").alias("derived_by"), F.lit(0).alias("hops"), F.lit(0.98).alias("confidence"))
    return called.unionByName(inside)


_VERBS = "'(?i)\\.(find|get|read|load|list|fetch|query|search|count|exists|select|save|insert|update|delete|remove|write|create|upsert|persist|put|merge)[A-Za-z0-9]*$'"


@query(with_(FACTS, LINKS, _STEPS) + f"""SELECT DISTINCT l.service, lower(regexp_replace(split_part(to_symbol, '.', 1), '([a-z0-9])([A-Z])', '\\1_\\2', 'g')) AS resource FROM st JOIN links l USING (connection_id) WHERE to_symbol IS NOT NULL AND regexp_matches(to_symbol, {_VERBS})
EXCEPT SELECT service, lower(d_table) FROM facts WHERE type = 'db_operation' AND d_table IS NOT NULL""")
def g18_missing_dependencies(spark, d):
    """Repository calls that call paths reach and no datastore fact names: methods that read or write by their verb."""
    s = _steps(spark, d).where("to_symbol is not null").join(B.links(spark, d).select("connection_id", "service"), "connection_id")
    found = s.where(F.col("to_symbol").rlike(STORE_VERBS)).select("service", N.snake(F.split_part("to_symbol", F.lit("."), F.lit(1))).alias("resource")).distinct()
    known = B.facts(spark, d).where("type = 'db_operation' and d_table is not null").select("service", F.lower("d_table").alias("resource"))
    return found.join(known, ["service", "resource"], "left_anti")


@query(with_(CALLS, EDGES, SERVICES, _WALK) + "SELECT s.service_id, r.node IS NOT NULL AS reachable FROM services s LEFT JOIN reach r ON r.node = CAST(s.service_id AS VARCHAR)")
def g19_reachability(spark, d, start="0"):
    reach = T.levels(edges(spark, d), spark.createDataFrame([(start,)], "root string"), 6)
    s = B.services(spark, d).select("service_id", F.col("service_id").cast("string").alias("node"))
    return s.join(reach.select("node", F.lit(True).alias("r")), "node", "left").select("service_id", F.coalesce("r", F.lit(False)).alias("reachable"))


@query()
def g20_layout_ranks(spark, d):
    """Layer and place of each service: longest-path layers of the edges that close no cycle in edge order, then four sweeps."""
    return T.layout(edges(spark, d), B.services(spark, d).select(F.col("service_id").alias("node")), ["src", "dst", "edge_type", "label"])


_RUNS2 = """r2 AS (SELECT project_id, run_id, row_number() OVER (PARTITION BY project_id ORDER BY started_at DESC, run_id) AS n FROM graph_runs WHERE status <> 'failed'),
cf AS (SELECT f.*, r2.n FROM contract_fields f JOIN r2 USING (project_id, run_id) WHERE r2.n <= 2),
occ AS (SELECT project_id, n, service, endpoint_id, string_agg(DISTINCT location || '/' || name || '/' || lower(trim(coalesce(type, ''))), ',' ORDER BY location || '/' || name || '/' || lower(trim(coalesce(type, '')))) AS shape, string_agg(DISTINCT method, ',' ORDER BY method) AS methods FROM cf GROUP BY ALL)"""


def _last_two(spark, d):
    r = table(spark, d, "graph_runs").where("status <> 'failed'").withColumn("n", F.row_number().over(Window.partitionBy("project_id").orderBy(F.desc("started_at"), "run_id"))).where("n <= 2").select("project_id", "run_id", "n")
    return table(spark, d, "contract_fields").join(r, ["project_id", "run_id"])


@query(with_(_RUNS2) + """SELECT coalesce(a.project_id, b.project_id) AS project_id, coalesce(a.service, b.service) AS service, coalesce(a.endpoint_id, b.endpoint_id) AS endpoint_id, CASE WHEN b.n IS NULL THEN 'added' WHEN a.n IS NULL THEN 'removed' ELSE 'modified' END AS change,
  concat_ws(',', CASE WHEN a.methods <> b.methods THEN 'methods' END, CASE WHEN a.shape <> b.shape THEN 'occurrences' END) AS fields FROM (SELECT * FROM occ WHERE n = 1) a FULL JOIN (SELECT * FROM occ WHERE n = 2) b USING (project_id, service, endpoint_id)
WHERE a.n IS NULL OR b.n IS NULL OR a.shape <> b.shape OR a.methods <> b.methods""")
def g21_graph_diff(spark, d):
    """Objects of the last two snapshots by semantic key: multisets of occurrences compared, generated ids and order ignored."""
    occ = F.concat_ws("/", "location", "name", F.lower(F.trim(F.coalesce("type", F.lit("")))))
    f = _last_two(spark, d).groupBy("project_id", "n", "service", "endpoint_id").agg(F.array_join(F.array_sort(F.collect_set(occ)), ",").alias("shape"), F.array_join(F.array_sort(F.collect_set("method")), ",").alias("methods"))
    k = ["project_id", "service", "endpoint_id"]
    a = f.where("n = 1").select(*k, F.col("shape").alias("sa"), F.col("methods").alias("ma"))
    b = f.where("n = 2").select(*k, F.col("shape").alias("sb"), F.col("methods").alias("mb"))
    j = a.join(b, k, "full_outer")
    change = F.when(F.col("sb").isNull(), "added").when(F.col("sa").isNull(), "removed").when((F.col("sa") != F.col("sb")) | (F.col("ma") != F.col("mb")), "modified")
    return j.select(*k, change.alias("change"), F.concat_ws(",", F.when(F.col("ma") != F.col("mb"), "methods"), F.when(F.col("sa") != F.col("sb"), "occurrences")).alias("fields")).where("change is not null")


@query(with_(_RUNS2, """one AS (SELECT project_id, n, service, endpoint_id, location, name, lower(trim(coalesce(type, ''))) AS type, coalesce(required, false) AS required, coalesce(nullable, false) AS nullable FROM cf
  QUALIFY row_number() OVER (PARTITION BY project_id, n, service, endpoint_id, location, name ORDER BY ingested_at DESC) = 1)""") + """
SELECT project_id, service, endpoint_id, location, name, CASE WHEN b.n IS NULL THEN 'added' WHEN a.n IS NULL THEN 'removed' ELSE 'modified' END AS change,
  CASE WHEN b.n IS NULL THEN CASE WHEN a.required THEN 'potentially_breaking' ELSE 'compatible' END WHEN a.n IS NULL THEN 'potentially_breaking'
    WHEN (NOT b.required AND a.required) OR (b.nullable AND NOT a.nullable) OR (a.type <> '' AND b.type <> '' AND a.type <> b.type) THEN 'potentially_breaking' ELSE 'compatible' END AS compatibility
FROM (SELECT * FROM one WHERE n = 1) a FULL JOIN (SELECT * FROM one WHERE n = 2) b USING (project_id, service, endpoint_id, location, name) WHERE a.n IS NULL OR b.n IS NULL OR a.type <> b.type OR a.required <> b.required OR a.nullable <> b.nullable""")
def g22_contract_diff(spark, d):
    """Contract changes between the last two snapshots, and whether they may break callers."""
    k = ["project_id", "service", "endpoint_id", "location", "name"]
    v = F.max(F.struct("ingested_at", F.lower(F.trim(F.coalesce("type", F.lit("")))).alias("type"), F.coalesce("required", F.lit(False)).alias("required"), F.coalesce("nullable", F.lit(False)).alias("nullable")))
    f = _last_two(spark, d).groupBy("n", *k).agg(v.alias("v"))
    j = f.where("n = 1").select(*k, F.col("v").alias("a")).join(f.where("n = 2").select(*k, F.col("v").alias("b")), k, "full_outer")
    a, b = (lambda n: F.col(f"a.{n}")), (lambda n: F.col(f"b.{n}"))
    differs = (a("type") != b("type")) | (a("required") != b("required")) | (a("nullable") != b("nullable"))
    change = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").when(differs, "modified")
    breaking = F.when(F.col("b").isNull(), a("required")).when(F.col("a").isNull(), F.lit(True)).otherwise((~b("required") & a("required")) | (b("nullable") & ~a("nullable")) | ((a("type") != "") & (b("type") != "") & (a("type") != b("type"))))
    return j.withColumn("change", change).where("change is not null").select(*k, "change", F.when(breaking, "potentially_breaking").otherwise("compatible").alias("compatibility"))


@query(with_(CALLS, EDGES, QUEUE_ROLES, RESOURCE_OPS, SERVICES, _IMP) + """, r AS (SELECT 'service:1' AS node, 0 AS depth UNION SELECT i.b, r.depth + 1 FROM r JOIN imp i ON i.a = r.node WHERE r.depth < 9), m AS (SELECT node, min(depth) AS depth FROM r GROUP BY node)
SELECT s.team, count(*) FILTER (WHERE depth = 1) AS direct, count(*) FILTER (WHERE depth > 1) AS indirect, (SELECT max(depth) FROM m) > 8 AS bounded FROM m JOIN services s ON m.node = 'service:' || s.service_id WHERE depth BETWEEN 1 AND 8 GROUP BY s.team""")
def g23_company_impact(spark, d, target="service:1", depth=8):
    """Affected services per team; bounded says whether more lies beyond the depth."""
    b = T.blast_radius(impact(spark, d), target, depth, nodes=None)
    s = B.services(spark, d).select(F.concat(F.lit("service:"), "service_id").alias("node"), "team")
    return b.join(s, "node").groupBy("team").agg(F.count_if(F.col("depth") == 1).alias("direct"), F.count_if(F.col("depth") > 1).alias("indirect"), F.max("bounded").alias("bounded"))


@query(with_(FACTS, LINKS, _STEPS) + """, e AS (SELECT entity_id AS entry FROM facts WHERE kind = 'exposure'), s AS (SELECT l.src AS entry, l.dst, l.connection_id, st.from_symbol, st.to_symbol, st.step_no FROM links l JOIN e ON e.entry = l.src LEFT JOIN st USING (connection_id))
SELECT entry, 'call' AS edge_kind, from_symbol AS from_node, to_symbol AS to_node, min(step_no) AS first_step, count(DISTINCT connection_id) AS connections FROM s WHERE from_symbol IS NOT NULL AND to_symbol IS NOT NULL GROUP BY entry, from_symbol, to_symbol
UNION ALL SELECT entry, 'reaches', entry, dst, NULL, count(DISTINCT connection_id) FROM s GROUP BY entry, dst UNION ALL SELECT entry, 'entry_only', entry, NULL, NULL, 0 FROM e WHERE entry NOT IN (SELECT src FROM links WHERE src IS NOT NULL)""")
def g24_flow_assembly(spark, d):
    """The flow of every entry point: its calls in order of the first step, what it reaches, or that it stands alone."""
    e = B.facts(spark, d).where("kind = 'exposure'").select(F.col("entity_id").alias("entry"))
    l = B.links(spark, d).select(F.col("src").alias("entry"), "dst", "connection_id").join(e, "entry")  # noqa: E741
    calls = l.join(_steps(spark, d), "connection_id").where("from_symbol is not null and to_symbol is not null").groupBy("entry", F.col("from_symbol").alias("from_node"), F.col("to_symbol").alias("to_node")).agg(F.min("step_no").alias("first_step"), F.countDistinct("connection_id").alias("connections"))
    none = F.lit(None).cast("int").alias("first_step")
    reach = l.groupBy("entry", F.col("dst").alias("to_node")).agg(F.countDistinct("connection_id").alias("connections"))
    alone = e.join(l.select("entry"), "entry", "left_anti")
    cols = ["entry", "edge_kind", "from_node", "to_node", "first_step", "connections"]
    return (
        calls.withColumn("edge_kind", F.lit("call")).select(cols)
        .unionByName(reach.select("entry", F.lit("reaches").alias("edge_kind"), F.col("entry").alias("from_node"), "to_node", none, "connections"))
        .unionByName(alone.select("entry", F.lit("entry_only").alias("edge_kind"), F.col("entry").alias("from_node"), F.lit(None).cast("string").alias("to_node"), none, F.lit(0).cast("bigint").alias("connections")))
    )


def _ends(n):
    pick = lambda fn, role: fn(F.when((F.col("role") == role) & F.col("ref").isNotNull(), F.col("ref")), F.when((F.col("role") == role) & F.col("ref").isNotNull(), F.col("pos")))
    return n.groupBy("doc", "flow_id").agg(pick(F.min_by, "entrypoint").alias("from_ref"), pick(F.max_by, "call").alias("to_ref"))


@query()
def g25_flow_projection(spark, d):
    """Connection of a flow, with flows and nodes as lists, bare records, maps or JSON text."""
    s = table(spark, d, "service_docs").dropDuplicates(["service_doc_id"]).select(F.col("service_doc_id").cast("string").alias("doc"), "body")
    return _ends(flow_nodes(s))
