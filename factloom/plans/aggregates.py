"""Aggregations: edges, resources, reconciliation, quality and job counters."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from factloom.functions import norm as N
from factloom.operators import reconcile as R
from factloom.operators import predicates as P
from factloom.plans import base as B
from factloom.plans.base import ATTEMPTS, CALLS, CLIENTS, FACTS, JOBS, LINKS, ORACLE, QUERIES, QUEUE_ROLES, RESOURCE_OPS, SERVICES, query, with_  # noqa: F401
from factloom.plans.normalizers import _OP, _PC, _PROFILE, _PROFILE_F, _SING
from factloom.plans.predicates import _CHANGED, _SAYS
from factloom.sources.tables import table


def edges(spark, d):
    """Aggregated call edges: number of facts, first label, weakest positive confidence."""
    c = B.calls(spark, d)
    weak = F.least(F.when(F.col("detection") > 0, F.col("detection")), F.when(F.col("resolution") > 0, F.col("resolution")))
    return c.groupBy("src", "dst", "edge_type").agg(F.count("*").alias("facts"), F.min_by("label", F.struct("fact_id", "label")).alias("label"), F.round(F.coalesce(F.min(weak), F.lit(0.0)), 6).alias("confidence"))


EDGES = """edges AS (SELECT src, dst, edge_type, count(*) AS facts, arg_min(label, {'f': fact_id, 'l': label}) AS label,
  round(coalesce(min(least(CASE WHEN detection > 0 THEN detection END, CASE WHEN resolution > 0 THEN resolution END)), 0.0), 6) AS confidence FROM calls GROUP BY ALL)"""


@query(with_(CALLS, EDGES) + "SELECT * FROM edges")
def a1_edge_aggregation(spark, d):
    return edges(spark, d)


@query(with_(RESOURCE_OPS) + "SELECT service_id, resource_name, category, string_agg(operation, ',' ORDER BY f, operation) AS label, CAST(sum(n) AS BIGINT) AS facts FROM (SELECT service_id, resource_name, category, operation, min(fact_id) AS f, count(*) AS n FROM resource_ops GROUP BY ALL) GROUP BY ALL")
def a2_resource_edges(spark, d):
    g = ["service_id", "resource_name", "category"]
    ops = B.resource_ops(spark, d).groupBy(*g, "operation").agg(F.min("fact_id").alias("f"), F.count("*").alias("n"))
    return ops.groupBy(*g).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("f", "operation"))), lambda x: x["operation"]), ",").alias("label"), F.sum("n").alias("facts"))


@query(with_(RESOURCE_OPS) + """SELECT service_id, resource_name, category, CASE WHEN n = 1 THEN only_op WHEN r = n THEN n || ' read ops' WHEN w = n THEN n || ' write ops' ELSE n || ' ops' END AS label FROM (
  SELECT service_id, resource_name, category, count(*) AS n, min(operation) AS only_op, count(*) FILTER (WHERE operation = 'read') AS r, count(*) FILTER (WHERE operation = 'write') AS w FROM resource_ops GROUP BY ALL)""")
def a3_resource_labels(spark, d):
    a = B.resource_ops(spark, d).withColumn("dir", N.direction("operation")).groupBy("service_id", "resource_name", "category").agg(
        F.count("*").alias("n"), F.min("operation").alias("only_op"), F.count_if(F.col("dir") == "read").alias("r"), F.count_if(F.col("dir") == "write").alias("w"))
    n = F.col("n").cast("string")
    return a.select("service_id", "resource_name", "category", F.when(F.col("n") == 1, F.col("only_op")).when(F.col("r") == F.col("n"), F.concat(n, F.lit(" read ops"))).when(F.col("w") == F.col("n"), F.concat(n, F.lit(" write ops"))).otherwise(F.concat(n, F.lit(" ops"))).alias("label"))


@query(with_(RESOURCE_OPS) + "SELECT resource_name, table_name, string_agg(DISTINCT operation, ',' ORDER BY operation) AS operations, count(*) AS n, count(DISTINCT service_id) AS services FROM resource_ops GROUP BY ALL")
def a4_resource_rollup(spark, d):
    return B.resource_ops(spark, d).groupBy("resource_name", "table_name").agg(F.array_join(F.array_sort(F.collect_set("operation")), ",").alias("operations"), F.count("*").alias("n"), F.countDistinct("service_id").alias("services"))


@query(with_(CALLS, EDGES, SERVICES, QUEUE_ROLES, B.SUBSCRIPTIONS) + """, touched AS (SELECT src AS n FROM edges UNION SELECT dst FROM edges UNION SELECT service_id FROM queue_roles),
links AS (SELECT topic, queue FROM subscriptions),
chains AS (SELECT p.service_id AS a, c.service_id AS b FROM queue_roles p JOIN queue_roles c ON p.queue_key = c.queue_key AND p.role = 'publish' AND c.role = 'consume'
  UNION SELECT p.service_id, c.service_id FROM queue_roles p JOIN links l ON l.topic = p.queue_key AND p.role = 'publish' JOIN queue_roles c ON c.queue_key = l.queue AND c.role = 'consume')
SELECT 'services' AS metric, count(*) AS value FROM services UNION ALL SELECT 'edges_' || edge_type, count(*) FROM edges GROUP BY edge_type
UNION ALL SELECT 'service_to_service', count(*) FROM edges UNION ALL SELECT 'isolated', count(*) FROM services WHERE service_id NOT IN (SELECT n FROM touched) UNION ALL SELECT 'async_chains', count(*) FROM chains""")
def a5_connectivity(spark, d):
    """Counts, edges by type, isolated services, producer-consumer pairs over one queue or one subscription hop."""
    e, s, q = edges(spark, d), B.services(spark, d), B.queue_roles(spark, d).distinct()
    touched = e.select("src").union(e.select("dst")).union(q.select("service_id")).distinct().toDF("service_id")
    links = B.subscriptions(spark, d)
    pub = q.where("role = 'publish'").select("queue_key", F.col("service_id").alias("a"))
    con = q.where("role = 'consume'").select("queue_key", F.col("service_id").alias("b"))
    # the topic reaches its own consumers and those of queues subscribed to it; services that reach the same queues count together
    reach = pub.union(pub.join(links, pub.queue_key == links.topic).select("queue", "a")).groupBy("a").agg(F.array_sort(F.collect_set("queue_key")).alias("queues"))
    alike = reach.groupBy("queues").agg(F.count("*").alias("n"))
    ends = alike.select("queues", "n", F.explode("queues").alias("queue_key")).join(con, "queue_key").groupBy("queues", "n").agg(F.countDistinct("b").alias("b"))
    chains = ends.agg(F.coalesce(F.sum(F.col("n") * F.col("b")), F.lit(0)).alias("value")).select(F.lit("async_chains").alias("metric"), "value")
    one = lambda name, df: df.agg(F.count("*").alias("value")).select(F.lit(name).alias("metric"), "value")
    by_type = e.groupBy("edge_type").count().select(F.concat(F.lit("edges_"), "edge_type").alias("metric"), F.col("count").alias("value"))
    out = one("services", s).union(by_type).union(one("service_to_service", e))
    return out.union(one("isolated", s.join(touched, "service_id", "left_anti"))).union(chains)


@query(with_(CALLS, EDGES, SERVICES) + "SELECT (SELECT count(*) FROM services) AS services, (SELECT count(*) FROM edges) AS edges, (SELECT string_agg(DISTINCT team, ',' ORDER BY team) FROM services) AS teams, (SELECT count(DISTINCT domain) FROM services) AS domains")
def a6_graph_summary(spark, d):
    s = B.services(spark, d).agg(F.count("*").alias("services"), F.array_join(F.array_sort(F.collect_set("team")), ",").alias("teams"), F.countDistinct("domain").alias("domains"))
    return s.join(edges(spark, d).agg(F.count("*").alias("edges"))).select("services", "edges", "teams", "domains")  # two single rows


@query(with_(CALLS, EDGES, SERVICES) + "SELECT service_id, name, team, coalesce(i, 0) AS edges_in, coalesce(o, 0) AS edges_out FROM services LEFT JOIN (SELECT dst, count(*) AS i FROM edges GROUP BY dst) ON dst = service_id LEFT JOIN (SELECT src, count(*) AS o FROM edges GROUP BY src) ON src = service_id")
def a7_service_degree(spark, d):
    e = edges(spark, d)
    i = e.groupBy(F.col("dst").alias("service_id")).agg(F.count("*").alias("edges_in"))
    o = e.groupBy(F.col("src").alias("service_id")).agg(F.count("*").alias("edges_out"))
    return B.services(spark, d).join(i, "service_id", "left").join(o, "service_id", "left").select("service_id", "name", "team", F.coalesce("edges_in", F.lit(0)).alias("edges_in"), F.coalesce("edges_out", F.lit(0)).alias("edges_out"))


@query("SELECT project_id, CAST(sum(coalesce(nullif(service_count, 0), 1)) AS BIGINT) AS services, CAST(sum(coalesce(nullif(edge_count, 0), service_count, 0)) AS BIGINT) AS edges, count(*) AS runs FROM graph_runs GROUP BY project_id")
def a8_view_rollup(spark, d):
    first_positive = lambda c, o: F.coalesce(F.nullif(F.col(c), F.lit(0)), o)
    return table(spark, d, "graph_runs").groupBy("project_id").agg(F.sum(first_positive("service_count", F.lit(1))).alias("services"), F.sum(first_positive("edge_count", F.coalesce("service_count", F.lit(0)))).alias("edges"), F.count("*").alias("runs"))


@query(with_(FACTS) + """SELECT resource_kind, identifier, services, n FROM (SELECT CASE WHEN type IN ('db_operation', 'cache_operation') THEN 'database' ELSE 'queue' END AS resource_kind, lower(trim(CASE WHEN type IN ('db_operation', 'cache_operation') THEN db_name ELSE host END)) AS identifier,
  string_agg(DISTINCT service, ',' ORDER BY service) AS services, count(DISTINCT service) AS n FROM facts WHERE type IN ('db_operation', 'cache_operation', 'queue_publish', 'queue_consumer', 'stream_consume') GROUP BY ALL)
WHERE coalesce(identifier, '') NOT IN ('', 'default', 'database', 'db', 'queue', 'topic') AND n >= 2""")
def a9_shared_resources(spark, d):
    data = F.col("type").isin("db_operation", "cache_operation")
    f = B.facts(spark, d).where(data | F.col("type").isin("queue_publish", "queue_consumer", "stream_consume"))
    g = f.groupBy(F.when(data, "database").otherwise("queue").alias("resource_kind"), N.lower(F.when(data, F.col("db_name")).otherwise(F.col("host"))).alias("identifier")).agg(F.array_sort(F.collect_set("service")).alias("s"))
    return g.where((F.size("s") >= 2) & ~F.col("identifier").isin("", "default", "database", "db", "queue", "topic")).select("resource_kind", "identifier", F.array_join("s", ",").alias("services"), F.size("s").cast("bigint").alias("n"))


@query(with_(CALLS, EDGES, SERVICES) + "SELECT service_id AS node, 'service' AS node_kind FROM services UNION SELECT n, 'identity_only' FROM (SELECT src AS n FROM edges UNION SELECT dst FROM edges) WHERE n NOT IN (SELECT service_id FROM services)")
def a10_graph_nodes(spark, d):
    """Nodes of the graph: services, and ends of edges that no service stands for."""
    s = B.services(spark, d).select(F.col("service_id").alias("node"))
    e = edges(spark, d)
    ends = e.select("src").union(e.select("dst")).distinct().toDF("node")
    return s.withColumn("node_kind", F.lit("service")).union(ends.join(s, "node", "left_anti").withColumn("node_kind", F.lit("identity_only")))


_PRIO = """CASE WHEN type = 'queue_publish' THEN 40 WHEN type IN ('queue_consumer', 'scheduled_job', 'webhook', 'rpc_endpoint', 'outbound_http', 'outbound_rpc', 'workflow_orchestration', 'db_operation', 'cache_operation') THEN 30
  WHEN type IN ('http_route', 'stream_consume') THEN 20 WHEN type IN ('cli_command', 'command_exec') THEN 10 ELSE 1 END"""
_CANON = r"""(SELECT CASE WHEN pth = '' THEN '' WHEN length(c0) > 1 THEN regexp_replace(c0, '/+$', '') ELSE c0 END)"""
_SEM = rf"""sem0 AS (SELECT *, lower(trim(coalesce(d_table, ''))) AS w, lower(trim(coalesce(operation_kind, ''))) AS o, lower(trim(coalesce(platform, ''))) AS p, lower(trim(coalesce(d_method, regexp_extract(name, '^(\S+)\s', 1)))) AS m,
    lower(trim(coalesce(d_path, regexp_extract(name, '\s(/.*)$', 1)))) AS pth, {_PRIO} AS prio FROM facts),
sem1 AS (SELECT *, array_to_string(list_transform(string_split(regexp_replace(CASE WHEN prefix(pth, '/') THEN pth ELSE '/' || pth END, '/+', '/', 'g'), '/'), lambda x: CASE WHEN x IN ('*', '**') OR regexp_matches(x, '^:|^\{{.*\}}$|^<.*>$') THEN '{{}}' ELSE x END), '/') AS c0 FROM sem0),
sem AS (SELECT *, CASE WHEN type IN ('db_operation', 'cache_operation') AND w <> '' THEN type || '|' || {_SING} || '|' || {_OP} || '|' || {_PC}
  WHEN type IN ('http_route', 'webhook', 'outbound_http') THEN type || '|' || m || '|' || CASE WHEN pth = '' THEN '' WHEN length(c0) > 1 THEN regexp_replace(c0, '/+$', '') ELSE c0 END || '|' || coalesce(file, '')
  WHEN type = 'scheduled_job' OR (type = 'cli_command' AND p <> 'sqs') THEN 'exposure-job|' || lower(trim(name)) || '|' || coalesce(file, '')
  ELSE p || '|' || lower(trim(coalesce(instance, ''))) || '|' || coalesce(nullif(trim(lower(operation)), ''), trim(lower(name))) || '|' || coalesce(file, '') END AS semantic FROM sem1)"""


def _dedupe_sql(source: str, keys: str, where: str) -> str:
    order = "prio DESC, coalesce(confidence, -1) DESC, coalesce(file, ''), coalesce(start_line, 0), entity_id"
    fields = ", ".join(f"first({f} ORDER BY {order}) FILTER (WHERE coalesce({f}, '') <> '') AS {f}" for f in R.FILLED)
    return f"SELECT {keys}, first(entity_id ORDER BY {order}) AS entity_id, first(name ORDER BY {order}) AS name, max(confidence) AS confidence, count(*) AS copies, {fields} FROM {source} WHERE {where} GROUP BY {keys}"


@query(with_(FACTS, _SEM) + _dedupe_sql("sem", "project_id, service, semantic", "kind = 'exposure'"))
def a11_dedupe_exposures(spark, d):
    return R.deduped(R.semantic_key(B.facts(spark, d).where("kind = 'exposure'")), "project_id", "service", "semantic")


@query(with_(FACTS, _SEM) + _dedupe_sql("sem", "project_id, service, semantic", "kind = 'dependency'"))
def a12_dedupe_dependencies(spark, d):
    return R.deduped(R.semantic_key(B.facts(spark, d).where("kind = 'dependency'")), "project_id", "service", "semantic")


@query(with_(FACTS, f"""b AS (SELECT *, {_SING} AS resource, {_OP} AS op, {_PC} AS engine0, {_PRIO} AS prio FROM (SELECT *, lower(trim(d_table)) AS w, lower(trim(coalesce(operation_kind, ''))) AS o, lower(trim(coalesce(platform, ''))) AS p FROM facts
  WHERE type IN ('db_operation', 'cache_operation') AND trim(coalesce(d_table, '')) <> '')),
folded AS (SELECT *, CASE WHEN engine0 = '' THEN coalesce(min(nullif(engine0, '')) OVER (PARTITION BY project_id, service, type, resource, op), '') ELSE engine0 END AS engine FROM b)""") + _dedupe_sql("folded", "project_id, service, type, resource, op, engine", "true"))
def a13_datastore_dedupe(spark, d):
    return R.deduped(R.fold_generic_platforms(B.facts(spark, d)), "project_id", "service", "type", "resource", "op", "engine")


@query(with_(FACTS) + """, n AS (SELECT entity_id, service, regexp_extract(t, '([^.]*)$', 1) AS base_name, regexp_extract(t, '^(.*)\\.[^.]*$', 1) AS schema_name, t FROM (
  SELECT entity_id, service, CASE WHEN platform = 'postgres' THEN 'public.' || d_table ELSE d_table END AS t FROM facts WHERE type = 'db_operation' AND d_table IS NOT NULL)),
k AS (SELECT service, base_name, min(schema_name) AS sole FROM n WHERE schema_name <> '' GROUP BY ALL HAVING count(DISTINCT schema_name) = 1)
SELECT entity_id, CASE WHEN schema_name = '' AND sole IS NOT NULL THEN sole || '.' || base_name ELSE t END AS qualified FROM n LEFT JOIN k USING (service, base_name)""")
def a14_schema_names(spark, d):
    f = B.facts(spark, d).where("type = 'db_operation' and d_table is not null").select("entity_id", "service", F.when(F.col("platform") == "postgres", F.concat(F.lit("public."), "d_table")).otherwise(F.col("d_table")).alias("t"))
    return R.adopt_schema(f, ["service"], "t").select("entity_id", "qualified")


@query(with_(FACTS) + f""", q AS (SELECT *, {_PRIO} AS prio, lower(coalesce(platform, '')) AS qp, regexp_replace(regexp_replace(lower(trim(regexp_extract(name, '^\\S+\\s+(.*)$', 1))), '[-_.](consumer|listener)$', ''), '[-_.]+$', '') AS destination FROM facts WHERE type IN ('queue_publish', 'queue_consumer', 'stream_consume'))
""" + _dedupe_sql("q", "project_id, service, type, qp, destination", "true"))
def a15_queue_variants(spark, d):
    f = B.facts(spark, d).where("type in ('queue_publish', 'queue_consumer', 'stream_consume')")
    f = f.withColumn("qp", F.lower(F.coalesce("platform", F.lit("")))).withColumn("destination", N.queue_destination(F.regexp_extract("name", r"^\S+\s+(.*)$", 1)))
    return R.deduped(f, "project_id", "service", "type", "qp", "destination")


@query(with_(FACTS) + f"SELECT project_id, service, type, best, filled FROM (SELECT project_id, service, type, first(entity_id ORDER BY {_PRIO} DESC, coalesce(confidence, -1) DESC, coalesce(file, ''), coalesce(start_line, 0), entity_id) AS best, count(*) FILTER (WHERE coalesce(host, '') <> '') AS filled FROM facts GROUP BY ALL)")
def a16_best_fact(spark, d):
    return B.facts(spark, d).groupBy("project_id", "service", "type").agg(F.min_by("entity_id", R.order_of()).alias("best"), F.count_if(F.coalesce("host", F.lit("")) != "").alias("filled"))


@query(with_(FACTS) + """SELECT DISTINCT kind, type, name, reason FROM (SELECT kind, type, name, CASE WHEN confidence IS NULL THEN 'missing_confidence' WHEN confidence < 0.7 THEN 'low_confidence' WHEN n_locations = 0 THEN 'missing_location' END AS reason FROM facts) WHERE reason IS NOT NULL""")
def a17_unresolved_items(spark, d):
    from factloom.operators.predicates import gate

    return gate(B.facts(spark, d)).where("reason is not null").select("kind", "type", "name", "reason").distinct()


@query(with_(FACTS) + """, o AS (SELECT service, coalesce(nullif(plugin_source, ''), 'none') AS pack, CASE plugin_source WHEN 'pack/company' THEN 2 WHEN 'pack/core' THEN 1 ELSE 0 END AS priority, tag FROM facts WHERE tag IS NOT NULL),
t AS (SELECT service, max(priority) AS top FROM o GROUP BY service)
SELECT o.service, CASE WHEN count(DISTINCT tag) = 1 THEN min(tag) END AS owner, count(DISTINCT tag) > 1 AS conflict, CAST(min(t.top) AS INT) AS priority FROM o JOIN t ON t.service = o.service AND t.top = o.priority GROUP BY o.service""")
def a18_identity_merge(spark, d):
    """Owner of a service: what the packs of highest priority say, a conflict if they disagree."""
    o = B.facts(spark, d).where("tag is not null").select("service", "tag", F.when(F.col("plugin_source") == "pack/company", 2).when(F.col("plugin_source") == "pack/core", 1).otherwise(0).alias("priority"))
    # tags at the top priority without a second pass: collect per priority, then take the greatest
    per = o.groupBy("service", "priority").agg(F.min("tag").alias("lo"), F.max("tag").alias("hi"))
    best = per.groupBy("service").agg(F.max(F.struct("priority", "lo", "hi")).alias("b"))
    return best.select("service", F.when(F.col("b.lo") == F.col("b.hi"), F.col("b.lo")).alias("owner"), (F.col("b.lo") != F.col("b.hi")).alias("conflict"), F.col("b.priority").alias("priority"))


@query(with_(LINKS) + """, p AS (SELECT connection_id, src, dst, unnest(paths) AS p FROM links WHERE src <> '' AND dst <> ''), h AS (SELECT src, dst, connection_id, coalesce(len(p.steps), 0) AS hops, p.id AS pid FROM p)
SELECT src, dst, CAST(min(hops) AS INT) AS min_hops, string_agg(DISTINCT pid, '|' ORDER BY pid) AS signature, count(*) AS n_paths, round(greatest(least(0.98 - 0.04 * (min(hops) - 1), 0.99), 0.5), 6) AS score FROM h GROUP BY src, dst""")
def a19_connection_build(spark, d):
    """Paths per pair: fewest hops, signature and score."""
    p = B.links(spark, d).where("src <> '' and dst <> ''").select("src", "dst", F.explode("paths").alias("p")).select("src", "dst", F.size(F.coalesce("p.steps", F.array())).alias("hops"), F.col("p.id").alias("pid"))
    score = F.round(F.greatest(F.least(F.lit(0.98) - F.lit(0.04) * (F.min("hops") - 1), F.lit(0.99)), F.lit(0.5)), 6)
    return p.groupBy("src", "dst").agg(F.min("hops").alias("min_hops"), F.array_join(F.array_sort(F.collect_set("pid")), "|").alias("signature"), F.count("*").alias("n_paths"), score.alias("score"))


@query(with_(LINKS) + "SELECT action, split_part(to_symbol, '.', 1) AS owner, count(*) AS n, count(DISTINCT connection_id) AS connections, min(connection_id) AS first_seen FROM (SELECT connection_id, unnest(p.steps, recursive := true) FROM (SELECT connection_id, unnest(paths) AS p FROM links)) GROUP BY ALL")
def a20_call_aggregation(spark, d):
    s = B.links(spark, d).select("connection_id", F.explode("paths").alias("p")).select("connection_id", F.explode("p.steps").alias("s"))
    return s.groupBy(F.col("s.action").alias("action"), F.split_part("s.to_symbol", F.lit("."), F.lit(1)).alias("owner")).agg(F.count("*").alias("n"), F.countDistinct("connection_id").alias("connections"), F.min("connection_id").alias("first_seen"))


@query(with_(LINKS) + """, s AS (SELECT DISTINCT split_part(to_symbol, '.', 1) AS owner, split_part(to_symbol, '.', 2) AS verb FROM (SELECT unnest(p.steps, recursive := true) FROM (SELECT unnest(paths) AS p FROM links)) WHERE to_symbol IS NOT NULL)
SELECT owner, verb FROM (SELECT *, bool_or(verb IN ('publish', 'archive', 'reprice', 'allocate')) OVER (PARTITION BY owner) AS corroborated FROM s) WHERE verb NOT IN ('get', 'list', 'update', 'create') OR corroborated""")
def a21_corroboration(spark, d):
    """Generic verbs only count where their owner also has a distinctive one."""
    s = B.links(spark, d).select(F.explode("paths").alias("p")).select(F.explode("p.steps").alias("s")).where("s.to_symbol is not null").select(F.split_part("s.to_symbol", F.lit("."), F.lit(1)).alias("owner"), F.split_part("s.to_symbol", F.lit("."), F.lit(2)).alias("verb")).distinct()
    distinctive = s.where(F.col("verb").isin("publish", "archive", "reprice", "allocate")).select("owner").distinct()
    generic = F.col("verb").isin("get", "list", "update", "create")
    return s.where(~generic).union(s.where(generic).join(distinctive, "owner", "left_semi").select("owner", "verb"))


@query(with_(CLIENTS) + f""", v AS (SELECT service, ref_kind AS key, host AS value, {_PROFILE} AS profile FROM (SELECT *, {_PROFILE_F} AS f FROM (SELECT *, regexp_replace(lower(trim(config_source)), ':.*$', '') AS p FROM clients WHERE coalesce(host, '') <> '' AND ref_kind IS NOT NULL AND config_source IS NOT NULL))),
g AS (SELECT service, key, min(value) AS lo, max(value) AS hi, min(value) FILTER (WHERE profile IN ('prod', 'production', 'prd', 'live')) AS plo, max(value) FILTER (WHERE profile IN ('prod', 'production', 'prd', 'live')) AS phi,
  min(value) FILTER (WHERE profile = '') AS blo, max(value) FILTER (WHERE profile = '') AS bhi FROM v GROUP BY ALL)
SELECT service, key, CASE WHEN lo = hi THEN lo WHEN plo = phi THEN plo WHEN blo = bhi THEN blo END AS value, CASE WHEN lo = hi THEN 'agree' WHEN plo = phi THEN 'production' WHEN blo = bhi THEN 'base' ELSE 'unresolved' END AS decided_by FROM g""")
def a22_config_consensus(spark, d):
    c = B.clients(spark, d).where("coalesce(host, '') <> '' and ref_kind is not null and config_source is not null")
    return R.consensus(c.select("service", F.col("ref_kind").alias("key"), F.col("host").alias("value"), N.config_profile("config_source").alias("profile")), ["service", "key"], "value", "profile")


@query(with_(FACTS) + r"""SELECT project_id, count(DISTINCT host) FILTER (WHERE host <> '') AS targets, count(*) FILTER (WHERE coalesce(host, '') = '' AND coalesce(url_template, '') = '' AND kind = 'dependency') AS unresolved, count(*) FILTER (WHERE n_evidence = 0) AS missing_evidence,
  count(*) FILTER (WHERE observed_at < TIMESTAMP '2025-03-01') AS stale FROM facts GROUP BY project_id""")
def a23_quality_counters(spark, d):
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    return B.facts(spark, d).groupBy("project_id").agg(
        F.countDistinct(F.when(F.col("host") != "", F.col("host"))).alias("targets"), F.count_if(blank("host") & blank("url_template") & (F.col("kind") == "dependency")).alias("unresolved"),
        F.count_if(F.col("n_evidence") == 0).alias("missing_evidence"), F.count_if(F.col("observed_at") < F.lit("2025-03-01").cast("timestamp")).alias("stale"))


@query(with_(JOBS, ATTEMPTS) + "SELECT j.status, count(DISTINCT j.job_id) AS jobs, count(a.attempt_id) AS attempts, round(coalesce(sum(a.duration), 0.0), 3) AS seconds FROM jobs j LEFT JOIN attempts a ON a.job_id = lower(j.job_id) GROUP BY j.status")
def a24_job_statistics(spark, d):
    a = B.attempts(spark, d).groupBy("job_id").agg(F.count("*").alias("n"), F.sum("duration").alias("t"))
    j = B.jobs(spark, d).withColumn("job_id", F.lower("job_id")).join(a, "job_id", "left")
    return j.groupBy("status").agg(F.count("*").alias("jobs"), F.sum(F.coalesce("n", F.lit(0))).alias("attempts"), F.round(F.coalesce(F.sum("t"), F.lit(0.0)), 3).alias("seconds"))


@query(with_(JOBS) + "SELECT project_id, count(*) FILTER (WHERE status IN ('queued', 'running')) AS pending, count(*) FILTER (WHERE status = 'running') AS running, count(*) AS known, count(*) FILTER (WHERE status IN ('queued', 'running')) < 3 AS admits FROM jobs GROUP BY project_id")
def a25_admission(spark, d):
    pending = F.count_if(F.col("status").isin("queued", "running"))
    return B.jobs(spark, d).groupBy("project_id").agg(pending.alias("pending"), F.count_if(F.col("status") == "running").alias("running"), F.count("*").alias("known"), (pending < 3).alias("admits"))


_RISK = " ".join(f"WHEN '{k}' THEN {v}" for k, v in P.CHANGE_RISK.items())


@query(with_(FACTS) + f""", f AS (SELECT service, file, {_CHANGED} AS c, greatest(coalesce(end_line, 0) - coalesce(start_line, 0), 0) AS lines FROM (SELECT *, lower(file) AS f FROM facts WHERE file IS NOT NULL)),
k AS (SELECT service, c, sum(lines) AS lines, count(DISTINCT file) AS files FROM f GROUP BY service, c),
v AS (SELECT lower(trim(service)) AS service, bool_or({_SAYS["public_surface_removal"]}) AS removal, bool_or({_SAYS["destructive_schema"]}) AS destructive FROM (SELECT DISTINCT ON (entity_id) entity_id, service, evidence FROM entities WHERE deleted_at IS NULL), LATERAL (SELECT lower(coalesce(e.snippet, '')) AS t FROM unnest(evidence) AS u(e)) GROUP BY 1),
s AS (SELECT service, sum(lines) AS lines, sum(files) AS files, sum(CASE WHEN r > 0 THEN least(r, 8 + files * 3) ELSE 0 END) AS risk, bool_or(c IN ('code', 'api', 'data')) AS source, bool_or(c = 'tests') AS tests, sum(CASE WHEN c IN ('api', 'data', 'security') THEN 8 ELSE 0 END) AS high FROM (SELECT *, CASE c {_RISK} END AS r FROM k) GROUP BY service)
SELECT service, CAST(score AS INT) AS score, CASE WHEN score >= 80 THEN 'critical' WHEN score >= 55 THEN 'high' WHEN score >= 30 THEN 'moderate' ELSE 'low' END AS level FROM (SELECT service, least(100, 5 + CASE WHEN lines > 1500 THEN 24 WHEN lines > 500 THEN 16 WHEN lines > 100 THEN 8 ELSE 0 END + CASE WHEN files > 50 THEN 20 WHEN files > 20 THEN 12 WHEN files > 8 THEN 5 ELSE 0 END + risk
  + CASE WHEN source AND NOT tests THEN 10 ELSE 0 END + high + CASE WHEN coalesce(removal, false) THEN 8 ELSE 0 END + CASE WHEN coalesce(destructive, false) THEN 8 ELSE 0 END) AS score FROM s LEFT JOIN v USING (service))""")
def a26_impact_score(spark, d):
    """Risk of changing all files of a service: size, categories, missing tests and signals."""
    f = B.facts(spark, d).where("file is not null").select("service", "file", P.changed_file_kind(F.col("file")).alias("c"), F.greatest(F.coalesce("end_line", F.lit(0)) - F.coalesce("start_line", F.lit(0)), F.lit(0)).alias("lines"))
    k = f.groupBy("service", "c").agg(F.sum("lines").alias("lines"), F.countDistinct("file").alias("files"))
    risk = F.create_map(*[F.lit(x) for kv in P.CHANGE_RISK.items() for x in kv])[F.col("c")]
    high = [c for c, x in P.CATEGORY_SIGNALS.items() if P.SEVERITY[x] == "high"]
    s = k.groupBy("service").agg(
        F.sum("lines").alias("lines"), F.sum("files").alias("files"), F.sum(F.when(risk > 0, F.least(risk, 8 + F.col("files") * 3)).otherwise(0)).alias("risk"), F.bool_or(F.col("c").isin("code", "api", "data")).alias("source"),
        F.bool_or(F.col("c") == "tests").alias("tests"), F.sum(F.when(F.col("c").isin(high), 8).otherwise(0)).alias("high"))
    e = table(spark, d, "entities").where("deleted_at is null").select("entity_id", N.lower("service").alias("service"), "evidence").dropDuplicates(["entity_id"]).select("service", F.explode("evidence.snippet").alias("t"))
    v = e.groupBy("service").agg(*(F.bool_or(P.patch_says(F.col("t"), x)).alias(x) for x in P.PATCH_SIGNALS))
    tier = lambda c, *steps: F.coalesce(*(F.when(F.col(c) > n, v_) for n, v_ in steps), F.lit(0))
    score = 5 + tier("lines", (1500, 24), (500, 16), (100, 8)) + tier("files", (50, 20), (20, 12), (8, 5)) + F.col("risk") + F.when(F.col("source") & ~F.col("tests"), 10).otherwise(0) + F.col("high")
    for x in P.PATCH_SIGNALS:
        score = score + F.when(F.coalesce(x, F.lit(False)), 8).otherwise(0)
    out = s.join(v, "service", "left").select("service", F.least(F.lit(100), score).cast("int").alias("score"))
    n = F.col("score")
    return out.withColumn("level", F.when(n >= 80, "critical").when(n >= 55, "high").when(n >= 30, "moderate").otherwise("low"))


@query("SELECT coalesce(error, 'none') AS reason, count(*) AS n FROM graph_runs GROUP BY ALL")
def a27_stage_failures(spark, d):
    return table(spark, d, "graph_runs").groupBy(F.coalesce("error", F.lit("none")).alias("reason")).agg(F.count("*").alias("n"))


@query(r"""SELECT cluster, count(*) AS n FROM (SELECT regexp_replace(regexp_replace(regexp_replace(lower(unnest(regexp_extract_all(text, '[^.\n]*(?:answered with|timeouts per minute|did not drain)[^.\n]*'))), '/[a-z0-9/_-]+', '<path>', 'g'), '[0-9a-f]{12,}', '<hex>', 'g'), '[0-9]+', '<n>', 'g') AS cluster FROM documents WHERE text IS NOT NULL) GROUP BY cluster""")
def a28_message_clusters(spark, d):
    """Failure messages by what is left when paths, hashes and numbers are masked."""
    m = table(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"[^.\n]*(?:answered with|timeouts per minute|did not drain)[^.\n]*"), F.lit(0))).alias("m"))
    masked = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower("m"), r"/[a-z0-9/_-]+", "<path>"), r"[0-9a-f]{12,}", "<hex>"), r"[0-9]+", "<n>")
    return m.groupBy(masked.alias("cluster")).agg(F.count("*").alias("n"))


@query(with_(FACTS, LINKS) + "SELECT service, count(*) AS unconnected FROM facts WHERE kind = 'exposure' AND entity_id NOT IN (SELECT src FROM links WHERE src IS NOT NULL) GROUP BY service")
def a29_unconnected_exposures(spark, d):
    used = B.links(spark, d).select(F.col("src").alias("entity_id")).distinct()
    return B.facts(spark, d).where("kind = 'exposure'").join(used, "entity_id", "left_anti").groupBy("service").agg(F.count("*").alias("unconnected"))


@query(with_(FACTS, _SEM, "ev AS (SELECT entity_id, unnest(evidence) AS e FROM (SELECT DISTINCT ON (entity_id) entity_id, evidence FROM entities))") + """
SELECT semantic, count(DISTINCT s.entity_id) AS facts, count(DISTINCT {'f': e.location.file, 'a': e.location.start_line, 'b': e.location.end_line, 's': e.snippet, 'o': e.source}) AS evidence FROM sem s JOIN ev USING (entity_id) GROUP BY semantic""")
def a30_evidence_merge(spark, d):
    """Evidence of one semantic object, each row once by place, snippet and source."""
    f = R.semantic_key(B.facts(spark, d)).select("entity_id", "semantic")
    ev = table(spark, d, "entities").dropDuplicates(["entity_id"]).select("entity_id", F.explode("evidence").alias("e"))
    return f.join(ev, "entity_id").groupBy("semantic").agg(F.countDistinct("entity_id").alias("facts"), F.countDistinct("e").alias("evidence"))
