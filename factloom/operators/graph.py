"""The architecture graph: typed nodes and aggregated edges from facts, and views on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import norm as N
from factloom.operators.resolve import route_matches
from factloom.session import cut

FORWARD = ("queue_publish", "queue_subscription", "queue_consume", "scheduler")
REVERSE = ("http", "rpc", "workflow", "database", "cache")


def typed_edges(facts: DataFrame) -> DataFrame:
    """(src, dst, edge_type, fact_id, confidence): one row per fact that makes an edge."""
    needed = ["entity_id", "project_id", "kind", "type", "name", "service", "host", "db_name", "instance", "confidence", "d_method", "d_path", "d_table"]
    facts = cut(facts.select(needed))  # read several times below; the scan and its deduplication run once
    t = F.col("type")
    svc = F.concat(F.lit("service:"), F.col("service"))
    queue = F.concat(F.lit("queue:"), N.queue_key(F.regexp_extract("name", r"^\S+\s+(.*)$", 1)))
    store = F.concat(F.lit("db:"), N.first_non_empty(F.lower("db_name"), F.lower("d_table"), F.lower("instance")))
    consumes, schedules = t.isin("queue_consumer", "stream_consume"), t == "scheduled_job"
    edge = F.when(t == "db_operation", "database").when(t == "cache_operation", "cache").when(t == "queue_publish", "queue_publish").when(consumes, "queue_consume").when(schedules, "scheduler")
    own = facts.select(
        F.when(consumes, queue).when(schedules, F.concat(F.lit("sched:"), N.identifier("name"))).otherwise(svc).alias("src"),
        F.when(t == "db_operation", store).when(t == "cache_operation", F.concat(F.lit("cache:"), "service")).when(t == "queue_publish", queue).otherwise(svc).alias("dst"),
        edge.alias("edge_type"), F.col("entity_id").alias("fact_id"), "confidence").where("edge_type is not null")
    routed = route_matches(facts).select(F.col("entity_id").alias("fact_id"), F.concat(F.lit("service:"), "to_service").alias("to"), F.col("confidence").alias("resolution"))
    http = facts.where("type = 'outbound_http'").select(svc.alias("src"), F.concat(F.lit("external:"), N.hostname("host")).alias("ext"), F.col("entity_id").alias("fact_id"), "confidence", (N.text("host") != "").alias("named")).join(routed, "fact_id", "left")
    known = F.col("to").isNotNull()
    http = http.where(known | F.col("named")).select(
        "src", F.coalesce("to", "ext").alias("dst"), F.when(known, "http").otherwise("external").alias("edge_type"), "fact_id", F.when(known, F.least("confidence", "resolution")).otherwise(F.col("confidence")).alias("confidence"))
    return own.unionByName(http)


def aggregated(edges: DataFrame) -> DataFrame:
    """One edge per (src, dst, type): number of facts and the weakest positive confidence; resource edges keep none."""
    weak = F.min(F.when(F.col("confidence") > 0, F.col("confidence")))
    return edges.groupBy("src", "dst", "edge_type").agg(F.count("*").alias("facts"), F.when(F.col("edge_type").isin("database", "cache"), F.lit(0.0)).otherwise(F.round(F.coalesce(weak, F.lit(0.0)), 6)).alias("confidence"))


def nodes(facts: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, node_kind): every service, and every end of an edge."""
    own = facts.select(F.concat(F.lit("service:"), "service").alias("node"))
    ends = edges.select("src").union(edges.select("dst")).toDF("node")
    return own.union(ends).distinct().withColumn("node_kind", F.split_part("node", F.lit(":"), F.lit(1)))


def impact_edges(edges: DataFrame) -> DataFrame:
    """Edges as `a change of a affects b`: along queues and schedulers forward, along calls and stores backward."""
    fwd = edges.where(F.col("edge_type").isin(*FORWARD)).select(F.col("src").alias("a"), F.col("dst").alias("b"), "edge_type")
    back = edges.where(F.col("edge_type").isin(*REVERSE)).select(F.col("dst").alias("a"), F.col("src").alias("b"), "edge_type")
    return fwd.union(back).distinct()
