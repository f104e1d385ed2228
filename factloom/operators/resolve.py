"""Resolving outbound facts to services: rules, routes, queues and identities, in ordered tiers that notice ambiguity.

Tiers are anti-join chains, not left to join reordering: a later tier only sees what earlier tiers left. Every join is
an equi join on a normalized key; containment is turned into one by exploding the target's token runs.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import norm as N
from factloom.operators.predicates import ADDRESS_TYPES
from factloom.session import cut

#: Well-known paths that many services expose, and beginnings of such; they identify none. Fixed values.
GENERIC_ROUTES = (
    "/oauth/token", "/oauth/authorize", "/token", "/login", "/logout", "/health", "/healthz", "/livez", "/readyz", "/status", "/info", "/metrics", "/version", "/ping", "/api-docs", "/error",
)
GENERIC_BEGINNINGS = ("/actuator", "/swagger", "/health/", "/.well-known")


NO_OWNER = "^(?:/?|" + "|".join(map(re.escape, GENERIC_ROUTES)) + ")$|^(?:" + "|".join(map(re.escape, GENERIC_BEGINNINGS)) + ")"


def routes(facts: DataFrame, types: tuple[str, ...]) -> DataFrame:
    """(entity_id, project_id, service, type, method, path) of facts with a route that can identify a service."""
    method = F.upper(F.coalesce(F.nullif(F.trim("d_method"), F.lit("")), N.http_method("name")))
    path = N.route_normal(F.coalesce(F.nullif(F.trim("d_path"), F.lit("")), N.http_path("name")))
    df = facts.where(F.col("type").isin(*types)).select("entity_id", "project_id", "service", "type", method.alias("method"), path.alias("path"))
    return df.where(~F.col("path").rlike(NO_OWNER))  # one look at the path: the condition is evaluated where the facts are read


def _few_owners(exposures: DataFrame, key: str) -> DataFrame:
    """The three smallest services of each (key, method) with their smallest entity: without the caller's own two are left, which tells ambiguity.

    So a path that a third of all rows share is a few rows in the join, whatever exposes it.
    """
    per = exposures.groupBy(F.col(key).alias(key), F.col("method").alias("e_method"), F.col("service").alias("to_service")).agg(F.min("entity_id").alias("to_entity"))
    return per.withColumn("n", F.row_number().over(Window.partitionBy(key, "e_method").orderBy("to_service"))).where("n <= 3").drop("n")


def owners(deps: DataFrame, exposures: DataFrame, key: str) -> DataFrame:
    """(entity_id, to_service, last, to_entity) of deps with any other service that exposes their (method, key); unique where to_service = last."""
    j = deps.join(_few_owners(exposures, key), key).where((F.col("to_service") != F.col("service")) & ((F.col("method") == F.col("e_method")) | (F.col("method") == "") | (F.col("e_method") == "")))
    return j.groupBy("entity_id").agg(F.min("to_service").alias("to_service"), F.max("to_service").alias("last"), F.min("to_entity").alias("to_entity"))


def unique_owner(deps: DataFrame, exposures: DataFrame, key: str) -> DataFrame:
    """deps with the one other service that exposes their (method, key); ambiguous and own routes match nothing."""
    return owners(deps, exposures, key).where(F.col("to_service") == F.col("last")).drop("last")


def route_matches(facts: DataFrame) -> DataFrame:
    """Exact route owners (.92), then, for what is left, owners by the route without leading version or audience segments (.84)."""
    ends = cut(routes(facts, ("outbound_http", "http_route", "webhook")))  # paths are normalized once
    deps, exps = ends.where("type = 'outbound_http'"), ends.where("type <> 'outbound_http'")
    any_exact = cut(owners(deps, exps, "path"))
    exact = any_exact.where(F.col("to_service") == F.col("last")).drop("last").withColumn("confidence", F.lit(0.92)).withColumn("tier", F.lit("exact"))
    strip = lambda df: df.withColumn("stripped", N.route_stripped(F.col("path")))
    rest = strip(deps.join(any_exact.select("entity_id"), "entity_id", "left_anti"))  # an ambiguous exact match is not retried
    return exact.unionByName(unique_owner(rest, strip(exps), "stripped").withColumn("confidence", F.lit(0.84)).withColumn("tier", F.lit("stripped")))


def queue_matches(facts: DataFrame) -> DataFrame:
    """Publishers with the first consuming service of the same topic (.90); of a topic the two first consumers are enough to leave out its publisher."""
    topic = N.queue_topic(F.regexp_extract("name", r"^\S+\s+(.*)$", 1))
    pub = facts.where("type = 'queue_publish'").select("entity_id", "service", topic.alias("topic")).where("topic <> ''")
    con = facts.where("type in ('queue_consumer', 'stream_consume')").select(topic.alias("topic"), F.col("service").alias("to_service"), F.col("entity_id").alias("to_entity")).where("topic <> ''")
    con = con.groupBy("topic", "to_service").agg(F.min("to_entity").alias("to_entity")).withColumn("n", F.row_number().over(Window.partitionBy("topic").orderBy("to_service"))).where("n <= 2").drop("n")
    j = pub.join(con, "topic").where("to_service <> service")
    return j.groupBy("entity_id").agg(F.min(F.struct("to_service", "to_entity")).alias("m")).select("entity_id", "m.to_service", "m.to_entity", F.lit(0.90).alias("confidence"))


def identity_candidates(deps: DataFrame, identities: DataFrame) -> DataFrame:
    """deps(entity_id, service, type, target) against identities(value, owner) in tiers: equal .95, same host .90, contained .75.

    Containment is an equi join: runs of tokens of the target, as long as the longest identity, against whole identities
    of five letters and more, then verified on token boundaries.
    """
    key = lambda c: F.regexp_replace(N.service_name(F.lower(c)), r"[^a-z0-9]+", "-")
    ids = identities.select("value", "owner", key(F.col("value")).alias("k"), N.hostname("value").alias("h"))
    t = deps.withColumn("k", key(F.col("target"))).withColumn("h", N.hostname("target"))
    equal = t.join(ids.select("k", "owner", "value"), "k").withColumn("confidence", F.lit(0.95))
    host = t.where("h <> ''").join(ids.where("h <> ''").select("h", "owner", "value"), "h").withColumn("confidence", F.lit(0.90))
    longest = identities.where(F.length("value") >= 5).agg(F.max(F.size(F.filter(F.split(F.lower("value"), r"[^a-z0-9]+"), lambda x: x != "")))).first()[0] or 1
    words = F.filter(F.split(F.lower("target"), r"[^a-z0-9]+"), lambda x: x != "")
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(longest)), lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(1))), lambda i: F.array_join(F.slice("w", i, n), "-"))))
    exploded = t.withColumn("w", words).where(F.size("w") > 0).withColumn("k", F.explode(F.array_distinct(runs)))
    contained = exploded.drop("w").join(ids.where(F.length(F.lower("value")) >= 5).select("k", "owner", "value"), "k").withColumn("confidence", F.lit(0.75))
    contained = contained.where(F.expr(r"concat(' ', lower(target), ' ') rlike concat('[^a-z0-9]', regexp_replace(lower(value), '([^a-z0-9])', '\\\\$1'), '[^a-z0-9]')"))
    cols = ["entity_id", "service", "type", "owner", "value", "confidence"]
    return equal.select(cols).union(host.select(cols)).union(contained.select(cols))


#: The least confidence of a procedure call's target.
RPC_LEAST = 0.9


def rpc_guard(candidates: DataFrame) -> Column:
    """Whether a candidate may stand: procedure calls need more than containment."""
    return ~(F.contains(F.col("type"), F.lit("rpc")) & (F.col("confidence") < RPC_LEAST))


def identity_matches(deps: DataFrame, identities: DataFrame) -> DataFrame:
    """The best (confidence, length) identity of each dependency; ties between services are conflicts, marked so."""
    every = identity_candidates(deps, identities)
    ok = every.where((F.col("owner") != F.col("service")) & rpc_guard(every))
    best = ok.groupBy("entity_id", "owner").agg(F.max(F.struct("confidence", F.length("value").alias("len"))).alias("s"))
    top = best.groupBy("entity_id").agg(F.max("s").alias("s"))
    at_top = best.join(top, ["entity_id", "s"])
    return at_top.groupBy("entity_id").agg(F.min("owner").alias("to_service"), F.first("s.confidence").alias("confidence"), (F.count("*") > 1).alias("conflict"))


def rule_matches(deps: DataFrame, rules: list[tuple[str, str, str, str, int, float]], services: DataFrame) -> DataFrame:
    """deps(entity_id, service, type, target) against rules (id, type pattern, target pattern, service template, priority, confidence).

    Rules are a stated list; each is one pair of predicates. The named service must exist and differ; of the highest
    priority all must agree, else the row is a conflict.
    """
    hits = [
        F.when(F.col("type").rlike(tp) & F.col("target").rlike(p), F.struct(F.lit(pr).alias("priority"), F.regexp_replace(F.regexp_extract("target", p, 0), p, to).alias("to_service"), F.lit(cf).alias("confidence"), F.lit(i).alias("rule_id")))
        for i, tp, p, to, pr, cf in rules
    ]
    j = deps.select("entity_id", "service", F.explode(F.array_compact(F.array(*hits))).alias("m")).select("entity_id", "service", "m.*").where("to_service <> service")
    j = j.join(services.select(F.col("service").alias("to_service")).distinct(), "to_service", "left_semi")
    per = j.groupBy("entity_id", "priority").agg(F.min("to_service").alias("to_service"), F.max("to_service").alias("last"), F.min("rule_id").alias("rule_id"), F.max("confidence").alias("confidence"))
    best = per.groupBy("entity_id").agg(F.max(F.struct("priority", "to_service", "last", "rule_id", "confidence")).alias("b"))
    return best.select("entity_id", "b.to_service", "b.rule_id", "b.priority", "b.confidence", (F.col("b.to_service") != F.col("b.last")).alias("conflict"))


def containing(points: DataFrame, ranges: DataFrame, slack: int = 1, bucket: int = 64) -> DataFrame:
    """points(point_id, file, line) with the smallest range(range_id, file, lo, hi) around them (one line of slack).

    A range join as an equi join on (file, line bucket): ranges are exploded into the buckets they touch.
    """
    r = ranges.withColumn("b", F.explode(F.sequence(F.floor((F.col("lo") - slack) / bucket), F.floor((F.col("hi") + slack) / bucket))))
    p = points.withColumn("b", F.floor(F.col("line") / bucket))
    j = p.join(r, ["file", "b"]).where((F.col("line") >= F.col("lo") - slack) & (F.col("line") <= F.col("hi") + slack))
    return j.groupBy("point_id").agg(F.min(F.struct((F.col("hi") - F.col("lo")).alias("span"), "lo", "range_id")).alias("m")).select("point_id", "m.range_id", F.col("m.span").alias("span"))


def service_addresses(facts: DataFrame) -> DataFrame:
    return facts.where(F.col("type").isin(*ADDRESS_TYPES))


def known_services(facts: DataFrame) -> Column:
    return facts.select("service").distinct()
