"""Shared fact tables for the queries, and the same tables as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL counterpart."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def facts(spark: SparkSession, d: str) -> DataFrame:
    """One row per entity that isn't withdrawn; redelivered copies are equal but for their arrival."""
    e = table(spark, d, "entities").where("deleted_at is null").dropDuplicates(["entity_id"])
    ref = {f: F.col(f"instance_ref.{s}") for f, s in (("ref_kind", "kind"), ("logical_name", "logical_name"), ("url_template", "url_template"), ("resolved_url", "resolved_url"), ("host", "host"), ("db_name", "database"), ("config_source", "config_source"), ("ref_source", "source"))}
    loc = F.try_element_at("source_locations", F.lit(1))
    return e.select(
        "entity_id", "project_id", "kind", "type", F.trim("name").alias("name"), F.lower(F.trim("service")).alias("service"), "platform", "instance", "operation", "operation_kind", "summary",
        *(c.alias(k) for k, c in ref.items()), loc["file"].alias("file"), loc["start_line"].alias("start_line"), loc["end_line"].alias("end_line"), F.size(F.coalesce("source_locations", F.array())).alias("n_locations"),
        F.size(F.coalesce("evidence", F.array())).alias("n_evidence"), "confidence", F.try_element_at("tags", F.lit(1)).alias("tag"), "details",
        F.get_json_object("details", "$.method").alias("d_method"), F.get_json_object("details", "$.path").alias("d_path"), F.get_json_object("details", "$.table").alias("d_table"), "plugin_source", "observed_at",
    )


FACTS = """facts AS (
  SELECT DISTINCT ON (entity_id) entity_id, project_id, kind, type, trim(name) AS name, lower(trim(service)) AS service, platform, instance, operation, operation_kind, summary,
    instance_ref.kind AS ref_kind, instance_ref.logical_name AS logical_name, instance_ref.url_template AS url_template, instance_ref.resolved_url AS resolved_url, instance_ref.host AS host,
    instance_ref.database AS db_name, instance_ref.config_source AS config_source, instance_ref.source AS ref_source,
    source_locations[1].file AS file, source_locations[1].start_line AS start_line, source_locations[1].end_line AS end_line, coalesce(len(source_locations), 0) AS n_locations,
    coalesce(len(evidence), 0) AS n_evidence, confidence, tags[1] AS tag, details,
    TRY_CAST(details AS JSON)->>'$.method' AS d_method, TRY_CAST(details AS JSON)->>'$.path' AS d_path, TRY_CAST(details AS JSON)->>'$.table' AS d_table, plugin_source, observed_at
  FROM entities WHERE deleted_at IS NULL)"""


def links(spark: SparkSession, d: str) -> DataFrame:
    """One row per connection."""
    c = table(spark, d, "connections").dropDuplicates(["connection_id"])
    return c.select(
        "connection_id", "project_id", F.lower(F.trim("service")).alias("service"), F.lower(F.trim("from_exposure_id")).alias("src"), F.lower(F.trim("to_dependency_id")).alias("dst"), "source",
        F.coalesce(F.nullif(F.lower(F.trim("status")), F.lit("")), F.lit("verified")).alias("status"), "condition_expr", "path_signature", "summary", "confidence", "from_type", "to_type", "paths", "created_at")


LINKS = """links AS (
  SELECT DISTINCT ON (connection_id) connection_id, project_id, lower(trim(service)) AS service, lower(trim(from_exposure_id)) AS src, lower(trim(to_dependency_id)) AS dst, source,
    coalesce(nullif(lower(trim(status)), ''), 'verified') AS status, condition_expr, path_signature, summary, confidence, from_type, to_type, paths, created_at
  FROM connections)"""


def clients(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "connection_clients").dropDuplicates(["client_id"])
    return c.select("client_id", "project_id", F.lower(F.trim("service")).alias("service"), "logical_name", "kind", "symbol", "framework", "config_anchor", F.col("instance_ref.kind").alias("ref_kind"),
                    F.col("instance_ref.logical_name").alias("ref_name"), F.col("instance_ref.url_template").alias("url_template"), F.col("instance_ref.host").alias("host"), F.col("instance_ref.database").alias("db_name"),
                    F.col("instance_ref.config_source").alias("config_source"), "contract_path", F.try_element_at("source_locations", F.lit(1))["file"].alias("file"))


CLIENTS = """clients AS (
  SELECT DISTINCT ON (client_id) client_id, project_id, lower(trim(service)) AS service, logical_name, kind, symbol, framework, config_anchor, instance_ref.kind AS ref_kind,
    instance_ref.logical_name AS ref_name, instance_ref.url_template AS url_template, instance_ref.host AS host, instance_ref.database AS db_name, instance_ref.config_source AS config_source,
    contract_path, source_locations[1].file AS file FROM connection_clients)"""


def calls(spark: SparkSession, d: str) -> DataFrame:
    """Directed call facts with two confidence signals, from consecutive order lines of different suppliers."""
    cols = ["l_orderkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus", "l_discount", "l_tax"]
    li = table(spark, d, "lineitem").select(*cols)
    a = li.where("l_quantity = 50").withColumn("next_line", F.col("l_linenumber") + 1).alias("a")
    b = li.select("l_orderkey", "l_suppkey", "l_linenumber").alias("b")
    on = (F.col("a.l_orderkey") == F.col("b.l_orderkey")) & (F.col("a.next_line") == F.col("b.l_linenumber")) & (F.col("a.l_suppkey") != F.col("b.l_suppkey"))
    return a.join(b, on).select(
        F.col("a.l_suppkey").alias("src"), F.col("b.l_suppkey").alias("dst"),
        F.when(F.col("a.l_returnflag") == "R", "http").when(F.col("a.l_returnflag") == "A", "rpc").otherwise("workflow").alias("edge_type"), F.col("a.l_linestatus").alias("label"), F.col("a.l_orderkey").alias("fact_id"),
        F.round(1 - (F.col("a.l_discount") + 0.0), 6).alias("detection"), F.round(1 - (F.col("a.l_tax") + 0.0), 6).alias("resolution"))


CALLS = """calls AS (
  SELECT a.l_suppkey AS src, b.l_suppkey AS dst, CASE a.l_returnflag WHEN 'R' THEN 'http' WHEN 'A' THEN 'rpc' ELSE 'workflow' END AS edge_type, a.l_linestatus AS label, a.l_orderkey AS fact_id,
    round(1 - (a.l_discount + 0.0), 6) AS detection, round(1 - (a.l_tax + 0.0), 6) AS resolution
  FROM lineitem a JOIN lineitem b ON b.l_orderkey = a.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 AND b.l_suppkey <> a.l_suppkey WHERE a.l_quantity = 50)"""


def services(spark: SparkSession, d: str) -> DataFrame:
    s, n, r = (table(spark, d, t) for t in ("supplier", "nation", "region"))
    return s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select(F.col("s_suppkey").alias("service_id"), F.col("s_name").alias("name"), F.col("n_name").alias("team"), F.col("r_name").alias("domain"))


SERVICES = """services AS (
  SELECT s.s_suppkey AS service_id, s.s_name AS name, n.n_name AS team, r.r_name AS domain FROM supplier s JOIN nation n ON n.n_nationkey = s.s_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey)"""


def resource_ops(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").where("l_quantity >= 49")
    p = table(spark, d, "part")
    return li.join(p, li.l_partkey == p.p_partkey).select(
        F.col("l_suppkey").alias("service_id"), F.col("p_brand").alias("resource_name"), F.col("p_name").alias("table_name"),
        F.when(F.col("p_type").isin("ECONOMY", "LARGE"), "database").when(F.col("p_type") == "PROMO", "cache").otherwise("object_storage").alias("category"),
        F.when(F.col("l_linestatus") == "F", "read").otherwise("write").alias("operation"), F.col("l_orderkey").alias("fact_id"))


RESOURCE_OPS = """resource_ops AS (
  SELECT l.l_suppkey AS service_id, p.p_brand AS resource_name, p.p_name AS table_name, CASE WHEN p.p_type IN ('ECONOMY', 'LARGE') THEN 'database' WHEN p.p_type = 'PROMO' THEN 'cache' ELSE 'object_storage' END AS category,
    CASE l.l_linestatus WHEN 'F' THEN 'read' ELSE 'write' END AS operation, l.l_orderkey AS fact_id FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey WHERE l.l_quantity >= 49)"""


def queue_roles(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").where("l_quantity = 50 AND l_returnflag IN ('R', 'A')")
    p = table(spark, d, "part")
    return li.join(p, li.l_partkey == p.p_partkey).select(F.lower(F.translate("p_brand", "#", "")).alias("queue_key"), F.col("l_suppkey").alias("service_id"), F.when(F.col("l_returnflag") == "R", "publish").otherwise("consume").alias("role"))


QUEUE_ROLES = """queue_roles AS (
  SELECT lower(replace(p.p_brand, '#', '')) AS queue_key, l.l_suppkey AS service_id, CASE l.l_returnflag WHEN 'R' THEN 'publish' ELSE 'consume' END AS role
  FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey WHERE l.l_quantity = 50 AND l.l_returnflag IN ('R', 'A'))"""


def subscriptions(spark: SparkSession, d: str) -> DataFrame:
    """Links of topics to queues that infrastructure declares, from consecutive order lines of different brands."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag")
    p = table(spark, d, "part").select("p_partkey", F.lower(F.translate("p_brand", "#", "")).alias("brand"))
    a = li.where("l_quantity = 50 AND l_returnflag = 'N'").join(p, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", (F.col("l_linenumber") + 1).alias("l_linenumber"), F.col("brand").alias("topic"))
    b = li.join(p, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", F.col("brand").alias("queue"))
    return a.join(b, ["l_orderkey", "l_linenumber"]).where("topic <> '' AND queue <> '' AND topic <> queue").select("topic", "queue").distinct()


SUBSCRIPTIONS = """subscriptions AS (
  SELECT DISTINCT lower(replace(p.p_brand, '#', '')) AS topic, lower(replace(q.p_brand, '#', '')) AS queue FROM lineitem a JOIN part p ON p.p_partkey = a.l_partkey
  JOIN lineitem b ON b.l_orderkey = a.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 JOIN part q ON q.p_partkey = b.l_partkey WHERE a.l_quantity = 50 AND a.l_returnflag = 'N' AND p.p_brand <> q.p_brand)"""


def jobs(spark: SparkSession, d: str) -> DataFrame:
    """One row per refresh job that isn't withdrawn."""
    return table(spark, d, "refresh_jobs").where("deleted_at is null").dropDuplicates(["job_id"])


JOBS = "jobs AS (SELECT DISTINCT ON (job_id) * FROM refresh_jobs WHERE deleted_at IS NULL)"


def attempts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "job_attempts").dropDuplicates(["attempt_id"]).withColumn("job_id", F.lower(F.trim("job_id")))


ATTEMPTS = "attempts AS (SELECT DISTINCT ON (attempt_id) * REPLACE (lower(trim(job_id)) AS job_id) FROM job_attempts)"


def with_(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n"
