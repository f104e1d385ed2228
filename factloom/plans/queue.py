"""Windows, orders and pages, set operations, and the job queue."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from factloom.functions import norm as N
from factloom.operators import jobs as J
from factloom.plans import base as B
from factloom.plans.aggregates import EDGES, edges
from factloom.plans.base import ATTEMPTS, CALLS, CLIENTS, FACTS, JOBS, LINKS, ORACLE, QUERIES, RESOURCE_OPS, query, with_  # noqa: F401
from factloom.sources.tables import table


# ---- windows --------------------------------------------------------------------------------------------------------
@query(with_(CALLS, EDGES) + "SELECT src, dst, edge_type, confidence, count(*) OVER (PARTITION BY src, confidence, facts) > 1 AS tied FROM edges QUALIFY rank() OVER (PARTITION BY src ORDER BY confidence DESC, facts DESC) = 1")
def w1_best_edges(spark, d):
    """The strongest edges of each service; ties are kept and marked."""
    e = edges(spark, d)
    top = e.groupBy("src").agg(F.max(F.struct("confidence", "facts")).alias("t"))
    at = e.join(top, "src").where((F.col("confidence") == F.col("t.confidence")) & (F.col("facts") == F.col("t.facts")))
    return at.select("src", "dst", "edge_type", "confidence", (F.count("*").over(Window.partitionBy("src")) > 1).alias("tied"))


@query(with_(FACTS) + "SELECT entity_id, service, plugin_source FROM facts QUALIFY rank() OVER (PARTITION BY service ORDER BY CASE plugin_source WHEN 'pack/company' THEN 2 WHEN 'pack/core' THEN 1 ELSE 0 END DESC) = 1")
def w2_rule_precedence(spark, d):
    f = B.facts(spark, d).withColumn("p", F.when(F.col("plugin_source") == "pack/company", 2).when(F.col("plugin_source") == "pack/core", 1).otherwise(0))
    top = f.groupBy("service").agg(F.max("p").alias("p"))
    return f.join(top, ["service", "p"]).select("entity_id", "service", "plugin_source")


@query(with_(FACTS) + "SELECT service, type, lower(name) AS key, entity_id FROM facts QUALIFY row_number() OVER (PARTITION BY service, type, lower(name) ORDER BY coalesce(file, ''), coalesce(start_line, 0), entity_id) = 1")
def w3_first_seen(spark, d):
    o = F.struct(F.coalesce("file", F.lit("")), F.coalesce("start_line", F.lit(0)), "entity_id")
    return B.facts(spark, d).groupBy("service", "type", F.lower("name").alias("key")).agg(F.min_by("entity_id", o).alias("entity_id"))


@query("SELECT project_id, arg_max(run_id, {'f': finished_at, 'r': run_id}) AS run_id, strftime(max(finished_at), '%Y-%m-%d %H:%M:%S') AS finished_at FROM graph_runs WHERE status IN ('succeeded', 'completed') GROUP BY project_id")
def w5_latest_runs(spark, d):
    r = table(spark, d, "graph_runs").where("status in ('succeeded', 'completed')")
    return r.groupBy("project_id").agg(F.max_by("run_id", F.struct("finished_at", "run_id")).alias("run_id"), F.date_format(F.max("finished_at"), "yyyy-MM-dd HH:mm:ss").alias("finished_at"))


@query(with_(CALLS, EDGES) + ", p AS (SELECT DISTINCT src AS n FROM edges UNION SELECT DISTINCT dst FROM edges) SELECT e.dst AS node, round(avg(e.src), 6) AS center, count(*) AS neighbours FROM (SELECT DISTINCT src, dst FROM edges) e GROUP BY e.dst")
def w7_barycentre(spark, d):
    return edges(spark, d).select("src", "dst").distinct().groupBy(F.col("dst").alias("node")).agg(F.round(F.avg("src"), 6).alias("center"), F.count("*").alias("neighbours"))


@query(with_(LINKS) + "SELECT src, dst, connection_id, CAST(n AS INT) AS n FROM (SELECT src, dst, connection_id, row_number() OVER (PARTITION BY src, dst ORDER BY created_at, connection_id) AS n FROM links WHERE src <> '' AND dst <> '') WHERE n <= 2")
def w8_paths_per_target(spark, d):
    l = B.links(spark, d).where("src <> '' and dst <> ''")  # noqa: E741
    return l.withColumn("n", F.row_number().over(Window.partitionBy("src", "dst").orderBy("created_at", "connection_id"))).where("n <= 2").select("src", "dst", "connection_id", "n")


@query("SELECT event_id, user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS sequence FROM events")
def w9_event_sequence(spark, d):
    return table(spark, d, "events").select("event_id", "user_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("sequence"))


# ---- orders, limits, pages --------------------------------------------------------------------------------------------
@query(with_(CALLS, EDGES) + "SELECT src, dst, edge_type, label FROM edges ORDER BY src, dst, edge_type, label")
def l1_edge_order(spark, d):
    return edges(spark, d).select("src", "dst", "edge_type", "label").orderBy("src", "dst", "edge_type", "label")


@query(with_(FACTS) + "SELECT entity_id, name FROM (SELECT * FROM facts WHERE contains(lower(name), 'order') ORDER BY entity_id LIMIT 50) ORDER BY name, entity_id")
def l3_search_cap(spark, d, cap=50):
    """The first hits in discovery order, then sorted: not the first of the sorted list."""
    return B.facts(spark, d).where(F.contains(F.lower("name"), F.lit("order"))).orderBy("entity_id").limit(cap).orderBy("name", "entity_id").select("entity_id", "name")


def _page(df, order, offset, size, most):
    """Rows of one page in order, with next_offset (null on the last page), has_more and total."""
    size = max(1, min(size, most))
    total = df.agg(F.count("*").alias("total"))
    more = F.col("total") > offset + size
    page = df.orderBy(*order).offset(offset).limit(size).crossJoin(F.broadcast(total))  # one row joins
    return page.withColumn("has_more", more).withColumn("next_offset", F.when(more, F.lit(offset + size))).orderBy(*order)


@query("SELECT run_id, project_id, strftime(started_at, '%Y-%m-%d %H:%M:%S') AS started_at, CASE WHEN (SELECT count(*) FROM graph_runs) > 505 THEN 505 END AS next_offset, (SELECT count(*) FROM graph_runs) AS total FROM graph_runs ORDER BY graph_runs.started_at DESC, run_id LIMIT 500 OFFSET 5")
def l4_run_page(spark, d, offset=5, size=1_000):
    """A page of runs, newest first; a page has at most 500."""
    p = _page(table(spark, d, "graph_runs").select("run_id", "project_id", "started_at"), (F.desc("started_at"), "run_id"), offset, size, 500)
    return p.select("run_id", "project_id", F.date_format("started_at", "yyyy-MM-dd HH:mm:ss").alias("started_at"), "next_offset", "total")


@query(with_(CALLS, EDGES) + "SELECT src, dst, edge_type, (SELECT count(*) FROM edges) > 150 AS has_more FROM edges ORDER BY src, dst, edge_type LIMIT 50 OFFSET 100")
def l5_dependency_page(spark, d, offset=100, size=50):
    """A page of dependencies; at most 200."""
    return _page(edges(spark, d), ("src", "dst", "edge_type"), offset, size, 200).select("src", "dst", "edge_type", "has_more")


@query(with_(JOBS) + "SELECT job_id, project_id, status, (SELECT count(*) FROM jobs) AS total, CASE WHEN (SELECT count(*) FROM jobs) > 100 THEN 100 END AS next_offset FROM jobs ORDER BY created_at DESC, job_id LIMIT 100")
def l6_job_page(spark, d, offset=0, size=100):
    return _page(B.jobs(spark, d), (F.desc("created_at"), "job_id"), offset, size, 500).select("job_id", "project_id", "status", "total", "next_offset")


@query(with_(FACTS) + "SELECT service, area, CAST(n AS BIGINT) AS n FROM (SELECT *, row_number() OVER (PARTITION BY service ORDER BY n DESC, area) AS r FROM (SELECT service, split_part(file, '/', 1) AS area, count(*) AS n FROM facts WHERE file IS NOT NULL GROUP BY ALL)) WHERE r <= 8")
def l8_top_areas(spark, d, k=8):
    a = B.facts(spark, d).where("file is not null").groupBy("service", F.split_part("file", F.lit("/"), F.lit(1)).alias("area")).agg(F.count("*").alias("n"))
    return a.withColumn("r", F.row_number().over(Window.partitionBy("service").orderBy(F.desc("n"), "area"))).where(F.col("r") <= k).drop("r")


@query("SELECT entity_id, array_to_string(list_transform(evidence[1:5], lambda e: coalesce(e.location.file, '')), ',') AS files FROM (SELECT DISTINCT ON (entity_id) entity_id, evidence FROM entities) WHERE len(evidence) > 0")
def l9_first_evidence(spark, d):
    e = table(spark, d, "entities").dropDuplicates(["entity_id"]).where("size(evidence) > 0")
    return e.select("entity_id", F.array_join(F.transform(F.slice("evidence", 1, 5), lambda x: F.coalesce(x["location"]["file"], F.lit(""))), ",").alias("files"))


# ---- set operations ---------------------------------------------------------------------------------------------------
@query(with_(FACTS, CLIENTS) + "SELECT service, type AS kind, host FROM facts UNION ALL SELECT service, kind, host FROM clients")
def u1_fact_union(spark, d):
    f = B.facts(spark, d).select("service", F.col("type").alias("kind"), "host")
    return f.unionByName(B.clients(spark, d).select("service", "kind", "host"))


@query("SELECT project_id, service, endpoint_id, location, name FROM (SELECT DISTINCT project_id, service, endpoint_id, location, name FROM contract_fields WHERE source = 'static' UNION SELECT DISTINCT project_id, service, endpoint_id, location, name FROM contract_fields WHERE source = 'route')")
def u3_key_union(spark, d):
    c = table(spark, d, "contract_fields")
    k = ["project_id", "service", "endpoint_id", "location", "name"]
    return c.where("source = 'static'").select(k).union(c.where("source = 'route'").select(k)).distinct()


_OCC = """r AS (SELECT project_id, run_id, row_number() OVER (PARTITION BY project_id ORDER BY started_at DESC, run_id) AS n FROM graph_runs WHERE status <> 'failed'),
o AS (SELECT project_id, n, endpoint_id, location || '/' || lower(trim(coalesce(type, ''))) AS occurrence FROM contract_fields JOIN r USING (project_id, run_id) WHERE n <= 2)"""


@query(f"WITH {_OCC} SELECT project_id, endpoint_id, occurrence, side, count(*) AS surplus FROM (SELECT *, 'before' AS side FROM (SELECT project_id, endpoint_id, occurrence FROM o WHERE n = 2 EXCEPT ALL SELECT project_id, endpoint_id, occurrence FROM o WHERE n = 1) UNION ALL SELECT *, 'after' FROM (SELECT project_id, endpoint_id, occurrence FROM o WHERE n = 1 EXCEPT ALL SELECT project_id, endpoint_id, occurrence FROM o WHERE n = 2)) GROUP BY ALL")
def u4_multiset_difference(spark, d):
    """Occurrences of each endpoint that the last two snapshots don't have equally often: equal multisets give no rows."""
    r = table(spark, d, "graph_runs").where("status <> 'failed'").withColumn("n", F.row_number().over(Window.partitionBy("project_id").orderBy(F.desc("started_at"), "run_id"))).where("n <= 2").select("project_id", "run_id", "n")
    k = ["project_id", "endpoint_id", "occurrence"]
    o = table(spark, d, "contract_fields").join(r, ["project_id", "run_id"]).select("n", "project_id", "endpoint_id", F.concat("location", F.lit("/"), F.lower(F.trim(F.coalesce("type", F.lit(""))))).alias("occurrence"))
    # one count per occurrence and side instead of two sorts of all rows
    c = o.groupBy(k).agg(F.count_if(F.col("n") == 1).alias("a"), F.count_if(F.col("n") == 2).alias("b"))
    return c.where("a <> b").select(*k, F.when(F.col("a") > F.col("b"), "after").otherwise("before").alias("side"), F.abs(F.col("a") - F.col("b")).alias("surplus"))


@query(with_(FACTS) + "SELECT service, string_agg(DISTINCT type, ',' ORDER BY type) AS types FROM facts GROUP BY service")
def u6_distinct_strings(spark, d):
    return B.facts(spark, d).groupBy("service").agg(F.array_join(F.array_sort(F.collect_set("type")), ",").alias("types"))


@query("""WITH s AS (SELECT DISTINCT endpoint_id, location, name, source FROM contract_fields) SELECT endpoint_id, location, name, source FROM s WHERE source = 'static'
UNION ALL SELECT endpoint_id, location, name, source FROM s x WHERE source <> 'static' AND NOT EXISTS (SELECT 1 FROM s y WHERE y.source = 'static' AND y.endpoint_id = x.endpoint_id AND y.location = x.location AND y.name = x.name)""")
def u8_field_merge(spark, d):
    """Fields of one source win over the others by endpoint, location and name."""
    c = table(spark, d, "contract_fields").select("endpoint_id", "location", "name", "source").distinct()
    own = c.where("source = 'static'")
    return own.unionByName(c.where("source <> 'static'").join(own.select("endpoint_id", "location", "name"), ["endpoint_id", "location", "name"], "left_anti").select(c.columns))


# ---- the job queue ----------------------------------------------------------------------------------------------------
@query(with_(JOBS) + "SELECT project_id, trigger_name, strftime(created_at, '%Y-%m-%d') AS day, min(job_id) AS job_id, count(*) AS deliveries, CASE WHEN count(DISTINCT coalesce(payload_digest, '')) > 1 THEN 'conflict' WHEN count(*) > 1 THEN 'repeated' ELSE 'accepted' END AS outcome FROM jobs GROUP BY ALL")
def t1_enqueue(spark, d):
    """Deliveries of one trigger and day: the same digest is one job, another digest a conflict."""
    return J.enqueue_outcome(B.jobs(spark, d).withColumn("day", F.date_format("created_at", "yyyy-MM-dd")), ["project_id", "trigger_name", "day"])


@query(with_(JOBS) + "SELECT project_id, trigger_name, max(job_id) AS job_id, count(*) AS coalesced FROM jobs WHERE status = 'queued' GROUP BY ALL")
def t2_coalesce(spark, d):
    return B.jobs(spark, d).where("status = 'queued'").groupBy("project_id", "trigger_name").agg(F.max("job_id").alias("job_id"), F.count("*").alias("coalesced"))


@query(with_(JOBS) + "SELECT project_id, trigger_name, job_id, strftime(not_before, '%Y-%m-%d %H:%M:%S') AS not_before FROM jobs j WHERE status = 'queued' AND NOT coalesce(cancel_requested, false) AND (project_id, trigger_name) NOT IN (SELECT (project_id, trigger_name) FROM jobs WHERE status = 'running') QUALIFY row_number() OVER (PARTITION BY project_id, trigger_name ORDER BY j.not_before, created_at, job_id) = 1")
def t3_claim(spark, d):
    return J.claimable(B.jobs(spark, d), ("project_id", "trigger_name")).withColumn("not_before", F.date_format("not_before", "yyyy-MM-dd HH:mm:ss"))


@query(with_(JOBS, ATTEMPTS) + "SELECT j.job_id, a.attempts, a.ended_us + CAST(power(2, least(attempts, 6)) AS BIGINT) * 1000000 AS retry_us FROM (SELECT lower(job_id) AS job_id, status, max_attempts FROM jobs) j JOIN (SELECT job_id, count(*) AS attempts, max(epoch_us(finished_at)) AS ended_us FROM attempts GROUP BY job_id) a USING (job_id) WHERE status IN ('failed', 'interrupted') AND a.attempts < j.max_attempts")
def t4_retry(spark, d):
    return J.retry_at(B.attempts(spark, d), B.jobs(spark, d))


@query(with_(JOBS) + "SELECT job_id, CASE WHEN coalesce(cancel_requested, false) AND status IN ('running', 'queued') THEN 'cancelled' WHEN status = 'running' THEN 'interrupted' ELSE status END AS status FROM jobs")
def t5_recovery(spark, d):
    return J.recover(B.jobs(spark, d)).select("job_id", "status")


@query(with_(ATTEMPTS) + """, s AS (SELECT job_id, status AS was, lead(status) OVER (PARTITION BY job_id ORDER BY attempt_no, attempt_id) AS then_status FROM attempts WHERE job_id <> '')
SELECT was, then_status, count(*) AS n, was || '>' || then_status IN ('queued>running', 'queued>cancelled', 'running>succeeded', 'running>failed', 'running>cancelled', 'running>interrupted', 'failed>queued', 'interrupted>queued') AS allowed FROM s WHERE then_status IS NOT NULL GROUP BY ALL""")
def t6_transitions(spark, d):
    """State changes between consecutive attempts and whether the state machine has them."""
    a = B.attempts(spark, d).where("job_id <> ''").withColumn("then_status", F.lead("status").over(Window.partitionBy("job_id").orderBy("attempt_no", "attempt_id"))).where("then_status is not null")
    g = a.groupBy(F.col("status").alias("was"), "then_status").agg(F.count("*").alias("n"))
    return g.select("was", "then_status", "n", J.allowed("was", "then_status").alias("allowed"))


@query("SELECT user_id, event_id, CAST(age AS INT) AS age FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS age FROM events) WHERE age <= 5")
def t7_ring_buffer(spark, d, n=5):
    return J.keep_last(table(spark, d, "events"), "user_id", [F.desc("ts"), F.desc("event_id")], n).select("user_id", "event_id", "age")


@query(with_(FACTS) + ", fp AS (SELECT service, file, md5(string_agg(coalesce(details, ''), '|' ORDER BY entity_id)) AS fingerprint FROM facts WHERE file IS NOT NULL GROUP BY ALL) SELECT service, file, fingerprint, count(*) OVER (PARTITION BY fingerprint) > 1 AS reusable FROM fp")
def t8_reuse(spark, d):
    """Content fingerprints per file; one seen elsewhere can be reused."""
    c = F.transform(F.array_sort(F.collect_list(F.struct("entity_id", F.coalesce("details", F.lit("")).alias("t")))), lambda x: x["t"])
    fp = B.facts(spark, d).where("file is not null").groupBy("service", "file").agg(F.md5(F.array_join(c, "|")).alias("fingerprint"))
    n = fp.groupBy("fingerprint").agg(F.count("*").alias("n"))
    return fp.join(n, "fingerprint").select("service", "file", "fingerprint", (F.col("n") > 1).alias("reusable"))


@query(with_(JOBS) + "SELECT job_id, CASE WHEN updated_at < created_at THEN 'rejected' WHEN status = 'failed' AND max_attempts > 3 THEN 'reopened' ELSE 'kept' END AS revision_outcome FROM jobs")
def t10_revisions(spark, d):
    """Optimistic revision: an update older than what is stored is rejected."""
    return B.jobs(spark, d).select("job_id", F.when(F.col("updated_at") < F.col("created_at"), "rejected").when((F.col("status") == "failed") & (F.col("max_attempts") > 3), "reopened").otherwise("kept").alias("revision_outcome"))
