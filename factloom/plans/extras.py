"""The remaining inventory rows: diff joins over two-run fixtures, orders, unions, JSON functions, source symbols."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from factloom.functions import norm as N
from factloom.operators import shredding
from factloom.operators import snapshots
from factloom.plans import base as B
from factloom.plans.aggregates import EDGES, edges
from factloom.plans.base import CALLS, CLIENTS, FACTS, JOBS, LINKS, ORACLE, QUERIES, query, with_  # noqa: F401
from factloom.plans.graphs import _GRAPH, graph_edges
from factloom.plans.joins import _RANGES
from factloom.plans.records import _P5
from factloom.sources.tables import table

_FX = """fx AS (SELECT CASE WHEN year(o.o_orderdate) % 2 = 0 THEN 'A' ELSE 'B' END AS run_id, c.c_mktsegment AS endpoint, n.n_name AS location, o.o_orderpriority AS field,
  2 * sum(CASE WHEN o.o_orderstatus = 'F' THEN 1 ELSE 0 END) >= count(*) AS required, sum(CASE WHEN c.c_acctbal < 0 THEN 1 ELSE 0 END) > 0 AS nullable, count(*) AS n
  FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey GROUP BY 1, 2, 3, 4 HAVING count(*) % 5 <> 0)"""


def _two_runs(spark, d):
    """Two snapshots of request fields from the order tables; some keys only exist in one of them."""
    o, c, n = table(spark, d, "orders"), table(spark, d, "customer"), table(spark, d, "nation")
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    g = j.groupBy(F.when(F.year("o_orderdate") % 2 == 0, "A").otherwise("B").alias("run_id"), F.col("c_mktsegment").alias("endpoint"), F.col("n_name").alias("location"), F.col("o_orderpriority").alias("field"))
    s = g.agg((2 * F.count_if(F.col("o_orderstatus") == "F") >= F.count("*")).alias("required"), (F.count_if(F.col("c_acctbal") < 0) > 0).alias("nullable"), F.count("*").alias("n"))
    return s.where(F.col("n") % 5 != 0)


_K = ["endpoint", "location", "field"]


@query(with_(_FX) + """SELECT endpoint, location, field, CASE WHEN b.run_id IS NULL THEN 'removed' WHEN a.run_id IS NULL THEN 'added' WHEN a.required <> b.required OR a.nullable <> b.nullable THEN 'modified' ELSE 'same' END AS change
FROM (SELECT * FROM fx WHERE run_id = 'A') a FULL JOIN (SELECT * FROM fx WHERE run_id = 'B') b USING (endpoint, location, field)""")
def j23_graph_diff_join(spark, d):
    r = _two_runs(spark, d)
    side = lambda run, n: r.where(F.col("run_id") == run).select(*_K, F.struct("required", "nullable").alias(n))
    j = side("A", "a").join(side("B", "b"), _K, "full_outer")
    return j.select(*_K, F.when(F.col("b").isNull(), "removed").when(F.col("a").isNull(), "added").when(F.col("a") != F.col("b"), "modified").otherwise("same").alias("change"))


@query(f"SELECT change, compatibility, count(*) AS n FROM (SELECT change, CASE change WHEN 'added' THEN CASE WHEN after_required THEN 'potentially_breaking' ELSE 'compatible' END WHEN 'removed' THEN 'potentially_breaking' ELSE CASE WHEN (NOT before_required AND after_required) OR (before_nullable AND NOT after_nullable) OR (before_type <> '' AND after_type <> '' AND before_type <> after_type) THEN 'potentially_breaking' ELSE 'compatible' END END AS compatibility FROM ({_P5.format(more=', before_type, before_required, before_nullable, after_type, after_required, after_nullable')})) GROUP BY ALL")
def j24_contract_diff_join(spark, d):
    """Changes between all consecutive snapshots by whether they may break callers."""
    c = snapshots.contract_changes(table(spark, d, "contract_fields"), table(spark, d, "graph_runs"))
    b, a = (lambda n: F.col(f"before.{n}")), (lambda n: F.col(f"after.{n}"))
    changed = (~b("required") & a("required")) | (b("nullable") & ~a("nullable")) | ((b("type") != "") & (a("type") != "") & (b("type") != a("type")))
    breaking = F.when(F.col("change") == "added", a("required")).when(F.col("change") == "removed", F.lit(True)).otherwise(changed)
    return c.groupBy("change", F.when(breaking, "potentially_breaking").otherwise("compatible").alias("compatibility")).agg(F.count("*").alias("n"))


@query(with_(FACTS, _RANGES) + "SELECT range_id, count(*) AS inside FROM (SELECT point_id, range_id FROM pt JOIN rg ON pt.file = rg.file AND line BETWEEN lo - 1 AND hi + 1 QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY hi - lo, lo, range_id) = 1) GROUP BY range_id")
def w4_innermost(spark, d):
    from factloom.plans.joins import j16_position_containment

    return j16_position_containment(spark, d).groupBy("range_id").agg(F.count("*").alias("inside"))


@query(with_(JOBS) + "SELECT project_id, trigger_name, count(*) AS waiting, min(job_id) AS first_id FROM jobs j WHERE status = 'queued' AND NOT EXISTS (SELECT 1 FROM jobs r WHERE r.status = 'running' AND r.project_id = j.project_id AND r.trigger_name = j.trigger_name) GROUP BY ALL")
def w6_serialized_lanes(spark, d):
    """Queued jobs of lanes without a running peer."""
    j, lane = B.jobs(spark, d), ["project_id", "trigger_name"]
    return j.where("status = 'queued'").join(j.where("status = 'running'").select(lane).distinct(), lane, "left_anti").groupBy(lane).agg(F.count("*").alias("waiting"), F.min("job_id").alias("first_id"))


@query(_GRAPH + "SELECT node, node_kind FROM gn ORDER BY node_kind, node")
def l2_node_order(spark, d):
    from factloom.plans.graphs import g1_graph_nodes

    return g1_graph_nodes(spark, d).orderBy("node_kind", "node")


@query(with_(LINKS) + "SELECT src, connection_id, CAST(total AS BIGINT) AS total FROM (SELECT src, connection_id, count(*) OVER (PARTITION BY src) AS total, row_number() OVER (PARTITION BY src ORDER BY connection_id) AS n FROM links WHERE src <> '') WHERE n <= 3")
def l7_trace_truncation(spark, d, shown=3):
    """The first connections of each entry point, sorted, with the full count."""
    l = B.links(spark, d).where("src <> ''")  # noqa: E741
    total = l.groupBy("src").agg(F.count("*").alias("total"))
    first = l.withColumn("n", F.row_number().over(Window.partitionBy("src").orderBy("connection_id"))).where(F.col("n") <= shown)
    return first.join(total, "src").select("src", "connection_id", "total")


@query("SELECT project_id, run_id, strftime(started_at, '%Y-%m-%d %H:%M:%S') AS started FROM graph_runs ORDER BY project_id, graph_runs.started_at DESC, run_id")
def l10_run_history(spark, d):
    return table(spark, d, "graph_runs").orderBy("project_id", F.desc("started_at"), "run_id").select("project_id", "run_id", F.date_format("started_at", "yyyy-MM-dd HH:mm:ss").alias("started"))


@query(with_(CALLS, EDGES) + "SELECT src, dst, edge_type, '{\"confidence\":' || CAST(CAST(confidence * 1000000 AS BIGINT) AS VARCHAR) || ',\"facts\":' || facts || ',\"label\":\"' || label || '\"}' AS canonical FROM edges")
def l11_canonical_json(spark, d):
    """A JSON text with sorted keys as the last tie break of an order."""
    doc = F.concat(F.lit('{"confidence":'), (F.col("confidence") * 1_000_000).cast("bigint"), F.lit(',"facts":'), F.col("facts"), F.lit(',"label":"'), F.col("label"), F.lit('"}'))
    return edges(spark, d).select("src", "dst", "edge_type", doc.alias("canonical"))


_KIND = {"outbound_http": "http", "outbound_rpc": "rpc", "db_operation": "db", "cache_operation": "cache", "queue_publish": "queue", "stream_consume": "stream"}
_KIND_SQL = "CASE type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _KIND.items()) + " END"


@query(with_(FACTS, CLIENTS) + f""", s AS (SELECT project_id, service, kind, min(host) AS host FROM clients WHERE host <> '' GROUP BY ALL HAVING count(DISTINCT host) = 1), f AS (SELECT *, {_KIND_SQL} AS ck FROM facts WHERE kind = 'dependency')
SELECT f.entity_id, coalesce(s.host, f.host) AS host, CASE WHEN s.host IS NULL THEN 'base' WHEN coalesce(f.host, '') = '' THEN 'filled' WHEN f.host = s.host THEN 'same' ELSE 'overlaid' END AS origin FROM f LEFT JOIN s ON s.project_id = f.project_id AND s.service = f.service AND s.kind = f.ck
UNION ALL SELECT 'client-' || client_id, host, 'supplement' FROM clients c WHERE host <> '' AND NOT EXISTS (SELECT 1 FROM f WHERE f.project_id = c.project_id AND f.service = c.service AND f.ck = c.kind)""")
def u2_supplement_union(spark, d):
    """Base facts overlaid with what the clients of their kind and service agree on, united with the clients that no fact stands for."""
    k = ["project_id", "service", "ck"]
    c = B.clients(spark, d).where("host <> ''").withColumnRenamed("kind", "ck")
    s = c.groupBy(k).agg(F.min("host").alias("s_host"), F.max("host").alias("last")).where("s_host = last").drop("last")
    f = B.facts(spark, d).where("kind = 'dependency'").withColumn("ck", F.create_map(*[F.lit(x) for kv in _KIND.items() for x in kv])[F.col("type")]).select("entity_id", *k, "host")
    origin = F.when(F.col("s_host").isNull(), "base").when(F.coalesce("host", F.lit("")) == "", "filled").when(F.col("host") == F.col("s_host"), "same").otherwise("overlaid")
    base = f.join(s, k, "left").select("entity_id", F.coalesce("s_host", "host").alias("host"), origin.alias("origin"))
    rest = c.join(f.select(k).distinct(), k, "left_anti")
    return base.unionByName(rest.select(F.concat(F.lit("client-"), "client_id").alias("entity_id"), "host", F.lit("supplement").alias("origin")))


@query(with_(_FX) + "SELECT endpoint, location, field, concat_ws(',', CASE WHEN a.n <> b.n THEN 'n' END, CASE WHEN a.nullable <> b.nullable THEN 'nullable' END, CASE WHEN a.required <> b.required THEN 'required' END) AS fields FROM (SELECT * FROM fx WHERE run_id = 'A') a JOIN (SELECT * FROM fx WHERE run_id = 'B') b USING (endpoint, location, field)")
def u5_changed_fields(spark, d):
    r = _two_runs(spark, d)
    a, b = (r.where(F.col("run_id") == x).select(*_K, *(F.col(c).alias(f"{x}_{c}") for c in ("n", "nullable", "required"))) for x in "AB")
    diff = [F.when(~F.col(f"A_{c}").eqNullSafe(F.col(f"B_{c}")), F.lit(c)) for c in ("n", "nullable", "required")]
    return a.join(b, _K).select(*_K, F.concat_ws(",", *diff).alias("fields"))


@query(with_(FACTS) + "SELECT service, type, name, count(*) AS results, string_agg(DISTINCT file || ':' || start_line, ',' ORDER BY file || ':' || start_line) AS locations FROM facts WHERE file IS NOT NULL AND start_line IS NOT NULL GROUP BY ALL")
def u7_discovery_merge(spark, d):
    """Results of several discoveries merged by name, their locations united."""
    at = F.concat("file", F.lit(":"), F.col("start_line"))
    return B.facts(spark, d).where("file is not null and start_line is not null").groupBy("service", "type", "name").agg(F.count("*").alias("results"), F.array_join(F.array_sort(F.collect_set(at)), ",").alias("locations"))


@query(with_(FACTS) + "SELECT entity_id, coalesce(d_path, TRY_CAST(details AS JSON)->>'$.metadata.details.path') AS path, TRY_CAST(details AS JSON)->>'$.metadata.rev' AS rev FROM facts WHERE details IS NOT NULL")
def fj_merged_details(spark, d):
    """Details with what an earlier stage kept under metadata: the normalized value wins."""
    j = lambda p: F.get_json_object("details", p)
    return B.facts(spark, d).where("details is not null").select("entity_id", F.coalesce("d_path", j("$.metadata.details.path")).alias("path"), j("$.metadata.rev").alias("rev"))


@query(with_(FACTS) + "SELECT service, string_agg(DISTINCT t, ',' ORDER BY t) AS tags FROM (SELECT lower(trim(e.service)) AS service, unnest(tags) AS t FROM (SELECT DISTINCT ON (entity_id) * FROM entities) e) GROUP BY service")
def fj_flattened_lists(spark, d):
    e = table(spark, d, "entities").dropDuplicates(["entity_id"]).select(N.lower("service").alias("service"), F.explode("tags").alias("t"))
    return e.groupBy("service").agg(F.array_join(F.array_sort(F.collect_set("t")), ",").alias("tags"))


@query()
def g22_contract_fields(spark, d):
    """Request fields of entry points from every place that declares them, in documents and in details, in any shape, one row each.

    A property of a body has its dotted name.
    """
    place = {"request_fields": ("body", "declared_or_static"), "body_fields": ("body", "static"), "query_params": ("query", "static"), "path_params": ("path", "route"), "headers": ("header", "static"), "properties": ("body", "schema")}
    texts = shredding.project_texts(table(spark, d, "service_docs"), table(spark, d, "entities").where("kind = 'exposure'"))
    nodes = shredding.adjacency(texts, shredding.SPECS, ("id", "name", "type", "required", "nullable"), wrap={"entities": "details"})
    k = F.regexp_extract("record_path", r"([a-z_]+)$", 1)
    rows = shredding.records(nodes, {"name": "name", "type": "type", "required": "required", "nullable": "nullable"}).withColumn("k", k).where(F.col("k").isin(*place))
    at = [F.create_map(*[F.lit(x) for n, v in place.items() for x in (n, v[i])])[F.col("k")] for i in (0, 1)]
    flag = lambda c: F.coalesce(F.col(c) == "true", F.lit(False)).alias(c)
    name = F.when(F.col("k") == "properties", F.regexp_extract("record_id", r"([^/]*)$", 1)).otherwise(F.col("name"))
    return rows.select(F.regexp_extract("record_id", r"^(.*)/[^/]*$", 1).alias("endpoint_id"), at[0].alias("location"), name.alias("name"), F.coalesce("type", F.lit("")).alias("type"), flag("required"), flag("nullable"), at[1].alias("source")).distinct()


@query("SELECT project_id, run_id, service, count(*) AS n FROM contract_fields GROUP BY ALL")
def s15_snapshot_partitions(spark, d):
    """What the snapshot writer would store per project, run and service."""
    return table(spark, d, "contract_fields").groupBy("project_id", "run_id", "service").agg(F.count("*").alias("n"))


@query(with_(FACTS) + "SELECT kind, type, name, service, min(entity_id) AS id, CASE WHEN max(confidence) >= 0.9 THEN 'high' WHEN max(confidence) >= 0.7 THEN 'medium' WHEN max(confidence) > 0 THEN 'low' ELSE 'unknown' END AS confidence FROM facts GROUP BY kind, type, name, service ORDER BY kind, type, service, name")
def s14_document_objects(spark, d):
    """Objects as a service document lists them: one per kind, type, service and name, with the confidence word, in canonical order."""
    c = F.max("confidence")
    o = B.facts(spark, d).groupBy("kind", "type", "name", "service").agg(F.min("entity_id").alias("id"), F.when(c >= 0.9, "high").when(c >= 0.7, "medium").when(c > 0, "low").otherwise("unknown").alias("confidence"))
    return o.orderBy("kind", "type", "service", "name")
