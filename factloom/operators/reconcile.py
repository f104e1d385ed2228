"""Reconciling facts: one surviving fact per identity with its gaps filled, variants folded, orphans set aside.

All of it is hash aggregation with map-side combining; ties are broken by an explicit order (file, line, id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import norm as N

FILLED = ("platform", "instance", "operation", "operation_kind", "summary", "host", "db_name", "file")


def order_of(prefix: str = "") -> Column:
    """Sorts better facts first: kind priority, confidence, then file, line and id."""
    c = lambda n: F.col(prefix + n)
    return F.struct(-N.priority(c("type")), -F.coalesce(c("confidence"), F.lit(-1.0)), F.coalesce(c("file"), F.lit("")), F.coalesce(c("start_line"), F.lit(0)), c("entity_id"))


def deduped(df: DataFrame, *keys: str, fields: tuple[str, ...] = FILLED) -> DataFrame:
    """One fact per key: the best one's id, each field from the best fact that has it, and how many there were."""
    o = order_of()
    filled = [F.min_by(F.when(F.coalesce(F.col(f).cast("string"), F.lit("")) != "", F.col(f)), F.when(F.coalesce(F.col(f).cast("string"), F.lit("")) != "", o)).alias(f) for f in fields]
    return df.groupBy(*keys).agg(F.min_by("entity_id", o).alias("entity_id"), F.min_by("name", o).alias("name"), F.max("confidence").alias("confidence"), F.count("*").alias("copies"), *filled)


def semantic_key(df: DataFrame) -> DataFrame:
    """With `semantic`: identity of a fact inside its service."""
    t = F.col("type")
    data = t.isin("db_operation", "cache_operation") & (N.text("d_table") != "")
    http = t.isin("http_route", "webhook", "outbound_http")
    job = (t == "scheduled_job") | ((t == "cli_command") & (N.lower("platform") != "sqs"))
    path = N.route_canonical(F.coalesce("d_path", F.regexp_extract("name", r"\s(/.*)$", 1)))
    method = N.lower(F.coalesce("d_method", F.regexp_extract("name", r"^(\S+)\s", 1)))
    file = F.coalesce("file", F.lit(""))
    key = (
        F.when(data, F.concat_ws("|", t, N.singular("d_table"), N.operation("operation_kind"), N.platform_class("platform"))).when(http, F.concat_ws("|", t, method, path, file))
        .when(job, F.concat_ws("|", F.lit("exposure-job"), N.lower("name"), file)).otherwise(F.concat_ws("|", N.lower("platform"), N.lower("instance"), N.first_non_empty(F.lower("operation"), F.lower("name")), file))
    )
    return df.withColumn("semantic", key)


def fold_generic_platforms(df: DataFrame) -> DataFrame:
    """Datastore facts of one (service, type, resource, operation): rows without engine join the first engine there is."""
    base = df.where(F.col("type").isin("db_operation", "cache_operation") & (N.text("d_table") != "")).select(
        "*", N.singular("d_table").alias("resource"), N.operation("operation_kind").alias("op"), N.platform_class("platform").alias("engine"))
    g = ["project_id", "service", "type", "resource", "op"]
    first = base.where("engine <> ''").groupBy(*g).agg(F.min("engine").alias("first_engine"))
    return base.join(first, g, "left").withColumn("engine", F.when(F.col("engine") == "", F.coalesce("first_engine", F.lit(""))).otherwise(F.col("engine"))).drop("first_engine")


def adopt_schema(df: DataFrame, group: list[str], name: str) -> DataFrame:
    """Bare names take the schema if exactly one schema was seen with that base name in the group."""
    base, schema = F.regexp_extract(name, r"([^.]*)$", 1), F.regexp_extract(name, r"^(.*)\.[^.]*$", 1)
    d = df.withColumn("base_name", base).withColumn("schema_name", schema)
    known = d.where("schema_name <> ''").groupBy(*group, "base_name").agg(F.min("schema_name").alias("only"), F.countDistinct("schema_name").alias("n")).where("n = 1").drop("n")
    j = d.join(known, [*group, "base_name"], "left")
    return j.withColumn("qualified", F.when((F.col("schema_name") == "") & F.col("only").isNotNull(), F.concat_ws(".", "only", "base_name")).otherwise(F.col(name))).drop("only")


def filter_connections(links: DataFrame, facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped with reason): connections whose two ends exist, and the others."""
    exp = facts.where("kind = 'exposure'").select(F.col("entity_id").alias("src")).distinct().withColumn("has_src", F.lit(True))
    dep = facts.where("kind = 'dependency'").select(F.col("entity_id").alias("dst")).distinct().withColumn("has_dst", F.lit(True))
    j = links.join(exp, "src", "left").join(dep, "dst", "left")
    reason = F.when(F.col("has_src").isNull() & F.col("has_dst").isNull(), "both_missing").when(F.col("has_src").isNull(), "exposure_missing").when(F.col("has_dst").isNull(), "dependency_missing")
    j = j.withColumn("reason", reason)
    return j.where("reason is null").select(links.columns), j.where("reason is not null").select(*links.columns, "reason")


def consensus(df: DataFrame, key: list[str], value: str, profile: str, active: str = "", production: tuple[str, ...] = ("prod", "production", "prd", "live")) -> DataFrame:
    """One value per key: what all agree on, else the active profile's, else production's, else the base one; null if none decides."""
    p = F.col(profile)

    def only(cond):
        v = F.when(cond, F.col(value))
        return F.when(F.min(v) == F.max(v), F.min(v))

    base_only = only(p == "")
    return df.groupBy(*key).agg(
        F.coalesce(F.when(F.min(value) == F.max(value), F.min(value)), only(p == active) if active else F.lit(None).cast("string"), only(p.isin(*production)), base_only).alias("value"),
        F.when(F.min(value) == F.max(value), "agree").when(only(p == active).isNotNull() if active else F.lit(False), "active").when(only(p.isin(*production)).isNotNull(), "production").when(base_only.isNotNull(), "base").otherwise("unresolved").alias("decided_by"))
