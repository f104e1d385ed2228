"""Joins: resolution tiers, aliases, orphans, lineage, containment, overlays and diffs."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import norm as N
from factloom.operators import reconcile as R
from factloom.operators import resolve as S
from factloom.plans import base as B
from factloom.plans.aggregates import EDGES, edges
from factloom.plans.base import CALLS, CLIENTS, FACTS, LINKS, ORACLE, QUERIES, SERVICES, query, with_  # noqa: F401
from factloom.plans.normalizers import _S0, _SVC
from factloom.sources.tables import table

RULES = [("to_engine", "^outbound_", r"^([a-z]+-[a-z]+)\..*$", "$1", 10, 0.9), ("to_keeper", "^outbound_", r"^([a-z]+)-keeper\..*$", "$1-keeper", 20, 0.95), ("to_hub", "^outbound_", r"^([a-z]+)-(?:hub|keeper)\..*$", "$1-hub", 20, 0.8)]

_DEPS = """deps AS (SELECT entity_id, service, type, coalesce(nullif(trim(host), ''), nullif(trim(logical_name), ''), nullif(trim(instance), ''), '') AS target FROM facts WHERE type IN ('outbound_http', 'outbound_rpc', 'queue_publish', 'stream_consume'))"""


def _deps(spark, d):
    return S.service_addresses(B.facts(spark, d)).select("entity_id", "service", "type", N.first_non_empty("host", "logical_name", "instance").alias("target"))


@query(with_(FACTS, _DEPS) + r""", hits AS (
  SELECT entity_id, service, 10 AS priority, regexp_replace(target, '^([a-z]+-[a-z]+)\..*$', '\1') AS to_service, 0.9 AS confidence, 'to_engine' AS rule_id FROM deps WHERE prefix(type, 'outbound_') AND regexp_matches(target, '^([a-z]+-[a-z]+)\..*$')
  UNION ALL SELECT entity_id, service, 20, regexp_replace(target, '^([a-z]+)-keeper\..*$', '\1-keeper'), 0.95, 'to_keeper' FROM deps WHERE prefix(type, 'outbound_') AND regexp_matches(target, '^([a-z]+)-keeper\..*$')
  UNION ALL SELECT entity_id, service, 20, regexp_replace(target, '^([a-z]+)-(?:hub|keeper)\..*$', '\1-hub'), 0.8, 'to_hub' FROM deps WHERE prefix(type, 'outbound_') AND regexp_matches(target, '^([a-z]+)-(?:hub|keeper)\..*$')),
ok AS (SELECT * FROM hits WHERE to_service <> service AND to_service IN (SELECT service FROM facts)), top AS (SELECT entity_id, max(priority) AS priority FROM ok GROUP BY entity_id)
SELECT entity_id, min(to_service) AS to_service, min(rule_id) AS rule_id, CAST(priority AS INT) AS priority, CAST(max(confidence) AS DOUBLE) AS confidence, count(DISTINCT to_service) > 1 AS conflict FROM ok JOIN top USING (entity_id, priority) GROUP BY entity_id, priority""")
def j1_rule_targets(spark, d):
    return S.rule_matches(_deps(spark, d), RULES, B.facts(spark, d))


_NR = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(regexp_replace(P, '\?.*$', ''))), '\{[^}/]+\}', '{}', 'g'), ':[a-z_][a-z0-9_]*', '{}', 'g'), '/+', '/', 'g'), '/+$', '')"""
_USABLE = "path NOT IN (" + ", ".join(f"'{x}'" for x in ("", "/", *S.GENERIC_ROUTES)) + ")" + "".join(f" AND NOT prefix(path, '{x}')" for x in S.GENERIC_BEGINNINGS)
_RT = rf"""rt AS (SELECT entity_id, type, service, method, CASE WHEN P = '' THEN '' WHEN {_NR} = '' THEN '/' ELSE {_NR} END AS path FROM (SELECT entity_id, type, service, upper(coalesce(nullif(trim(d_method), ''), regexp_extract(name, '(?i)\b(GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)\s+\S+', 1))) AS method,
  coalesce(nullif(trim(d_path), ''), regexp_extract(name, '(?i)\b(?:GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)\s+(\S+)', 1)) AS P FROM facts WHERE type IN ('outbound_http', 'http_route', 'webhook'))),
rdep AS (SELECT * FROM rt WHERE type = 'outbound_http' AND {_USABLE}),
rexp AS (SELECT * FROM rt WHERE type <> 'outbound_http' AND {_USABLE}),
ex AS (SELECT a.entity_id, b.service AS to_service, b.entity_id AS to_entity FROM rdep a JOIN rexp b ON a.path = b.path AND a.service <> b.service AND (a.method = b.method OR a.method = '' OR b.method = '')),
exact AS (SELECT entity_id, min(to_service) AS to_service, min(to_entity) AS to_entity FROM ex GROUP BY entity_id HAVING count(DISTINCT to_service) = 1),
st AS (SELECT a.entity_id, b.service AS to_service, b.entity_id AS to_entity FROM rdep a JOIN rexp b ON regexp_replace(a.path, '^((?:/(?:api|v1|v2|public|internal))+)(/.*)$', '\2') = regexp_replace(b.path, '^((?:/(?:api|v1|v2|public|internal))+)(/.*)$', '\2')
  AND a.service <> b.service AND (a.method = b.method OR a.method = '' OR b.method = '') WHERE a.entity_id NOT IN (SELECT entity_id FROM ex)),
stripped AS (SELECT entity_id, min(to_service) AS to_service, min(to_entity) AS to_entity FROM st GROUP BY entity_id HAVING count(DISTINCT to_service) = 1)"""


@query(with_(FACTS, _RT) + "SELECT *, 0.92::DOUBLE AS confidence FROM exact")
def j2_route_exact(spark, d):
    return S.route_matches(B.facts(spark, d)).where("tier = 'exact'").drop("tier")


@query(with_(FACTS, _RT) + "SELECT *, 0.84::DOUBLE AS confidence FROM stripped")
def j3_route_stripped(spark, d):
    return S.route_matches(B.facts(spark, d)).where("tier = 'stripped'").drop("tier")


@query(with_(FACTS) + r""", q AS (SELECT *, regexp_replace(lower(trim(regexp_extract(name, '^\S+\s+(.*)$', 1))), '[-_.]+', '', 'g') AS topic FROM facts WHERE type IN ('queue_publish', 'queue_consumer', 'stream_consume'))
SELECT entity_id, split_part(m, '|', 1) AS to_service, split_part(m, '|', 2) AS to_entity, 0.9::DOUBLE AS confidence FROM (SELECT a.entity_id, min(b.service || '|' || b.entity_id) AS m FROM q a JOIN q b ON a.topic = b.topic AND a.topic <> '' AND a.type = 'queue_publish' AND b.type <> 'queue_publish' AND a.service <> b.service GROUP BY ALL)""")
def j4_queue_topics(spark, d):
    return S.queue_matches(B.facts(spark, d))


_SVX = _SVC.replace("s0", "x0")
_SX0 = r"replace(regexp_replace(regexp_replace(trim(lower({c})), '^service\.', ''), '^external\.', ''), '_', '-')"
_HOST = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim({c})), '^(jdbc:)?[a-z][a-z0-9+.-]*://', ''), '[/?#].*$', ''), '^[^@]*@', ''), ':\d+$', ''), '(\.svc\.cluster\.local|\.cluster\.local|\.corp\.example)$', '')"


_TIERS = rf""", i0 AS (SELECT DISTINCT service AS value, service AS owner FROM facts), i AS (SELECT value, owner, regexp_replace({_SVX}, '[^a-z0-9]+', '-', 'g') AS k, {_HOST.format(c='value')} AS h FROM (SELECT *, {_SX0.format(c='value')} AS x0 FROM i0)),
t AS (SELECT entity_id, service, type, target, regexp_replace({_SVX}, '[^a-z0-9]+', '-', 'g') AS k, {_HOST.format(c='target')} AS h FROM (SELECT *, {_SX0.format(c='target')} AS x0 FROM deps)),
m AS (SELECT t.*, i.owner, i.value, 0.95 AS c FROM t JOIN i ON t.k = i.k UNION ALL SELECT t.*, i.owner, i.value, 0.9 FROM t JOIN i ON t.h = i.h AND t.h <> ''
  UNION ALL SELECT t.*, i.owner, i.value, 0.75 FROM t JOIN i ON length(i.value) >= 5 AND regexp_matches(lower(t.target), '(^|[^a-z0-9])' || regexp_escape(lower(i.value)) || '([^a-z0-9]|$)'))"""


@query(with_(FACTS, _DEPS) + _TIERS + r""",
ok AS (SELECT * FROM m WHERE owner <> service AND NOT (contains(type, 'rpc') AND c < 0.9)), best AS (SELECT entity_id, owner, max(c * 1000 + length(value)) AS s, max(c) AS c FROM ok GROUP BY ALL), top AS (SELECT entity_id, max(s) AS s FROM best GROUP BY ALL)
SELECT entity_id, min(owner) AS to_service, CAST(max(c) AS DOUBLE) AS confidence, count(*) > 1 AS conflict FROM best JOIN top USING (entity_id, s) GROUP BY entity_id""")
def j5_tiered_identity(spark, d):
    ids = B.facts(spark, d).select(F.col("service").alias("value"), F.col("service").alias("owner")).distinct()
    return S.identity_matches(_deps(spark, d), ids)


@query(with_(FACTS, _DEPS) + _TIERS + " SELECT entity_id, type, owner, CAST(max(c) AS DOUBLE) AS confidence, NOT (contains(type, 'rpc') AND max(c) < 0.9) AS stands FROM m WHERE owner <> service GROUP BY entity_id, type, owner")
def j6_rpc_guard(spark, d):
    """Every candidate owner of a target with its best tier, and whether the guard lets it stand."""
    ids = B.facts(spark, d).select(F.col("service").alias("value"), F.col("service").alias("owner")).distinct()
    c = S.identity_candidates(_deps(spark, d), ids).where("owner <> service").groupBy("entity_id", "type", "owner").agg(F.max("confidence").alias("confidence"))
    return c.select("entity_id", "type", "owner", "confidence", S.rpc_guard(c).alias("stands"))


@query(with_(FACTS) + r"SELECT entity_id, coalesce(nullif(trim(host), ''), nullif(trim(logical_name), ''), '') <> '' OR regexp_matches(coalesce(url_template, ''), '^[a-z]+://[^/$]') AS has_destination FROM facts WHERE type = 'outbound_http'")
def j7_destination_guard(spark, d):
    f = B.facts(spark, d).where("type = 'outbound_http'")
    return f.select("entity_id", ((N.first_non_empty("host", "logical_name") != "") | F.coalesce("url_template", F.lit("")).rlike(r"^[a-z]+://[^/$]")).alias("has_destination"))


@query(with_(FACTS) + """, s AS (SELECT DISTINCT service FROM facts WHERE kind = 'exposure'), c AS (SELECT DISTINCT logical_name AS raw FROM facts WHERE logical_name <> ''),
a AS (SELECT DISTINCT service, unnest([service, replace(service, '-', '_'), replace(service, '-', ''), service || '-api']) AS alias FROM s)
SELECT raw, min(service) AS service FROM c JOIN a ON lower(trim(raw)) = alias GROUP BY raw""")
def j8_known_services(spark, d):
    """Raw names that are a spelling of a known service; the smallest service name on collisions."""
    f = B.facts(spark, d)
    s = f.where("kind = 'exposure'").select("service").distinct()
    variants = F.array("service", F.translate("service", "-", "_"), F.translate("service", "-", ""), F.concat("service", F.lit("-api")))
    a = s.select("service", F.explode(F.array_distinct(variants)).alias("alias"))
    raw = f.where("logical_name <> ''").select(F.col("logical_name").alias("raw")).distinct()
    return raw.join(a, N.lower("raw") == F.col("alias")).groupBy("raw").agg(F.min("service").alias("service"))


@query(with_(FACTS, _RT) + "SELECT entity_id, to_service, to_entity FROM exact")
def j9_route_owner(spark, d):
    f = B.facts(spark, d)
    return S.unique_owner(S.routes(f, ("outbound_http",)), S.routes(f, ("http_route", "webhook")), "path")


@query(with_(FACTS, LINKS) + "SELECT l.connection_id, coalesce(a.name, l.src) AS from_name, coalesce(b.name, l.dst) AS to_name FROM links l LEFT JOIN facts a ON a.entity_id = l.src LEFT JOIN facts b ON b.entity_id = l.dst")
def j10_connection_names(spark, d):
    names = B.facts(spark, d).select("entity_id", "name")
    a, b = names.toDF("src", "a"), names.toDF("dst", "b")
    return B.links(spark, d).join(a, "src", "left").join(b, "dst", "left").select("connection_id", F.coalesce("a", "src").alias("from_name"), F.coalesce("b", "dst").alias("to_name"))


_SD = """sd AS (SELECT DISTINCT ON (service_doc_id) service_doc_id AS id, TRY_CAST(body AS JSON) AS j FROM service_docs),
sev AS (SELECT id, e->>'$.id' AS eid, e->>'$.file' AS file FROM (SELECT id, unnest(CASE WHEN json_type(j, '$.evidence') = 'ARRAY' THEN (j->'$.evidence')::JSON[] ELSE [] END) AS e FROM sd)),
sob AS (SELECT id, o->>'$.id' AS oid, (o->'$.evidence_refs')::VARCHAR[] AS refs FROM (SELECT id, unnest(CASE WHEN json_type(j, '$.objects.db_queries') = 'ARRAY' THEN (j->'$.objects.db_queries')::JSON[] ELSE [] END) AS o FROM sd)),
srf AS (SELECT id, oid, generate_subscripts(refs, 1) AS pos, unnest(refs) AS eid FROM sob)"""


@query(with_(_SD) + "SELECT CAST(s.id AS VARCHAR) AS doc, oid AS object_id, string_agg(v.file, ',' ORDER BY pos) AS files FROM srf s JOIN sev v ON v.id = s.id AND v.eid = s.eid GROUP BY ALL")
def j11_evidence_hydration(spark, d):
    """Evidence of objects in the order of their references; references to nothing are skipped."""
    s = table(spark, d, "service_docs").dropDuplicates(["service_doc_id"]).select(F.col("service_doc_id").cast("string").alias("doc"), F.try_parse_json("body").alias("j"))
    each = lambda path, n: s.select("doc", F.expr(f"try_variant_get(j, '{path}', 'array<variant>')").alias("a")).select("doc", F.explode("a").alias(n))
    ev = each("$.evidence", "e").select("doc", F.expr("try_variant_get(e, '$.id', 'string')").alias("eid"), F.expr("try_variant_get(e, '$.file', 'string')").alias("file"))
    ob = each("$.objects.db_queries", "o").select("doc", F.expr("try_variant_get(o, '$.id', 'string')").alias("object_id"), F.posexplode(F.expr("try_variant_get(o, '$.evidence_refs', 'array<string>')")).alias("pos", "eid"))
    return ob.join(ev, ["doc", "eid"]).groupBy("doc", "object_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "file"))), lambda x: x["file"]), ",").alias("files"))


@query(with_(FACTS, LINKS) + """SELECT connection_id, CASE WHEN a.entity_id IS NULL AND b.entity_id IS NULL THEN 'both_missing' WHEN a.entity_id IS NULL THEN 'exposure_missing' WHEN b.entity_id IS NULL THEN 'dependency_missing' ELSE 'kept' END AS outcome
FROM links l LEFT JOIN facts a ON a.entity_id = l.src AND a.kind = 'exposure' LEFT JOIN facts b ON b.entity_id = l.dst AND b.kind = 'dependency'""")
def j12_orphan_filter(spark, d):
    kept, dropped = R.filter_connections(B.links(spark, d), B.facts(spark, d))
    return kept.select("connection_id", F.lit("kept").alias("outcome")).union(dropped.select("connection_id", "reason"))


@query("""WITH f AS (SELECT DISTINCT project_id, service, endpoint_id, lower(replace(replace(name, '_', ''), '-', '')) AS field, CASE location WHEN 'path' THEN 'from' ELSE 'to' END AS side FROM contract_fields WHERE location IN ('path', 'body')),
g AS (SELECT project_id, service, field FROM f GROUP BY ALL HAVING bool_or(side = 'from') AND bool_or(side = 'to') AND count(DISTINCT endpoint_id) > 1)
SELECT project_id, service, field, endpoint_id, side FROM f JOIN g USING (project_id, service, field)""")
def j13_field_lineage(spark, d):
    """Fields that carry one canonical name from a path into a body of another endpoint of their service.

    One row per endpoint and side: every `from` of a (project, service, field) leads to every `to` of another endpoint. A
    field that thousands of endpoints share is so many rows, not their pairs.
    """
    k = ["project_id", "service", "field"]
    f = table(spark, d, "contract_fields").where("location in ('path', 'body')").select("project_id", "service", F.lower(F.translate("name", "_-", "")).alias("field"), "endpoint_id", F.when(F.col("location") == "path", "from").otherwise("to").alias("side")).distinct()
    g = f.groupBy(k).agg(F.bool_or(F.col("side") == "from").alias("a"), F.bool_or(F.col("side") == "to").alias("b"), F.min("endpoint_id").alias("lo"), F.max("endpoint_id").alias("hi"))
    return f.join(g.where("a and b and lo < hi").select(k), k, "left_semi").select(*k, "endpoint_id", "side")


@query(with_(FACTS, CLIENTS) + """, u AS (SELECT project_id, service, kind, min(client_id) AS client_id, count(*) AS n FROM clients GROUP BY ALL)
SELECT f.entity_id, u.client_id FROM facts f JOIN u ON u.project_id = f.project_id AND u.service = f.service AND u.kind = CASE f.type WHEN 'outbound_http' THEN 'http' WHEN 'db_operation' THEN 'db' WHEN 'cache_operation' THEN 'cache' WHEN 'queue_publish' THEN 'queue' WHEN 'stream_consume' THEN 'stream' END AND u.n = 1""")
def j14_client_propagation(spark, d):
    """Operations take the identity of the only client of their kind in their service."""
    u = B.clients(spark, d).groupBy("project_id", "service", F.col("kind").alias("ck")).agg(F.min("client_id").alias("client_id"), F.count("*").alias("n")).where("n = 1").drop("n")
    kinds = F.create_map(*[F.lit(x) for p in {"outbound_http": "http", "db_operation": "db", "cache_operation": "cache", "queue_publish": "queue", "stream_consume": "stream"}.items() for x in p])
    return B.facts(spark, d).withColumn("ck", kinds[F.col("type")]).join(u, ["project_id", "service", "ck"]).select("entity_id", "client_id")


@query(with_(CLIENTS) + """, p AS (SELECT * FROM clients WHERE framework IS NOT NULL AND framework <> ''), s AS (SELECT * FROM clients WHERE coalesce(framework, '') = '')
SELECT client_id, true AS is_primary FROM p UNION ALL SELECT client_id, false FROM s WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.service = s.service AND p.kind = s.kind AND
  ((p.config_anchor <> '' AND p.config_anchor = s.config_anchor) OR (p.symbol <> '' AND split_part(p.symbol, '.', -1) = split_part(s.symbol, '.', -1)) OR (p.logical_name <> '' AND p.logical_name = s.logical_name)))""")
def j15_client_merge(spark, d):
    """Secondary clients that share no key (anchor, symbol tail, name) with a primary one of the service and kind."""
    c = B.clients(spark, d)
    key = lambda tag, v: F.when(F.coalesce(v, F.lit("")) != "", F.concat_ws("|", F.lit(tag), "service", "kind", v))
    keys = F.array_compact(F.array(key("a", F.col("config_anchor")), key("s", F.regexp_extract("symbol", r"([^.]*)$", 1)), key("n", F.col("logical_name"))))
    primary = F.coalesce("framework", F.lit("")) != ""
    pk = c.where(primary).select(F.explode(keys).alias("k")).distinct()
    covered = c.where(~primary).select("client_id", F.explode(keys).alias("k")).join(pk, "k", "left_semi").select("client_id").distinct()
    return c.where(primary).select("client_id", F.lit(True).alias("is_primary")).union(c.where(~primary).join(covered, "client_id", "left_anti").select("client_id", F.lit(False)))


_RANGES = "rg AS (SELECT entity_id AS range_id, file, start_line AS lo, end_line AS hi FROM facts WHERE kind = 'exposure' AND file IS NOT NULL AND start_line IS NOT NULL AND end_line >= start_line), pt AS (SELECT entity_id AS point_id, file, start_line AS line FROM facts WHERE kind = 'dependency' AND file IS NOT NULL AND start_line IS NOT NULL)"


@query(with_(FACTS, _RANGES) + "SELECT point_id, range_id, CAST(hi - lo AS INT) AS span FROM pt JOIN rg ON pt.file = rg.file AND line BETWEEN lo - 1 AND hi + 1 QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY hi - lo, lo, range_id) = 1")
def j16_position_containment(spark, d):
    f = B.facts(spark, d).where("file is not null and start_line is not null")
    return S.containing(f.where("kind = 'dependency'").select(F.col("entity_id").alias("point_id"), "file", F.col("start_line").alias("line")),
                        f.where("kind = 'exposure' and end_line >= start_line").select(F.col("entity_id").alias("range_id"), "file", F.col("start_line").alias("lo"), F.col("end_line").alias("hi")))


@query(with_(FACTS) + "SELECT a.entity_id AS exposure, b.entity_id AS dependency, 0.98::DOUBLE AS score FROM facts a JOIN facts b ON a.service = b.service AND a.file = b.file AND a.kind = 'exposure' AND b.kind = 'dependency' AND b.start_line >= a.start_line AND b.end_line <= a.end_line AND b.end_line - b.start_line <= 3")
def j17_direct_containment(spark, d):
    f = B.facts(spark, d)
    a = f.where("kind = 'exposure'").select(F.col("entity_id").alias("exposure"), "service", "file", F.col("start_line").alias("lo"), F.col("end_line").alias("hi"))
    b = f.where("kind = 'dependency' and end_line - start_line <= 3").select(F.col("entity_id").alias("dependency"), "service", "file", "start_line", "end_line")
    return a.join(b, ["service", "file"]).where("start_line >= lo and end_line <= hi").select("exposure", "dependency", F.lit(0.98).alias("score"))


_STEPS = "st AS (SELECT DISTINCT connection_id, s.step_no AS step_no, s.from_symbol AS from_symbol, s.to_symbol AS to_symbol FROM (SELECT connection_id, unnest(p.steps) AS s FROM (SELECT connection_id, unnest(paths) AS p FROM links)))"


def _steps(spark, d):
    return B.links(spark, d).select("connection_id", F.explode("paths").alias("p")).select("connection_id", F.explode("p.steps").alias("s")).select("connection_id", "s.step_no", "s.from_symbol", "s.to_symbol").distinct()


@query(with_(FACTS, LINKS, _STEPS) + "SELECT DISTINCT st.to_symbol AS symbol, l.dst AS dependency FROM st JOIN links l USING (connection_id) JOIN facts f ON f.entity_id = l.dst AND f.kind = 'dependency' WHERE st.to_symbol IS NOT NULL")
def j18_symbol_index(spark, d):
    deps = B.facts(spark, d).where("kind = 'dependency'").select(F.col("entity_id").alias("dst"))
    l = B.links(spark, d).select("connection_id", "dst").join(deps, "dst", "left_semi")  # noqa: E741
    return _steps(spark, d).where("to_symbol is not null").join(l, "connection_id").select(F.col("to_symbol").alias("symbol"), F.col("dst").alias("dependency")).distinct()


@query(with_(LINKS, _STEPS) + """, defs AS (SELECT DISTINCT from_symbol AS sym, split_part(from_symbol, '.', 2) AS m FROM st WHERE from_symbol IS NOT NULL), one AS (SELECT m, min(sym) AS sym FROM defs GROUP BY m HAVING count(*) = 1)
SELECT DISTINCT to_symbol AS call, coalesce(d.sym, o.sym) AS target, CASE WHEN d.sym IS NOT NULL THEN 'exact' WHEN o.sym IS NOT NULL THEN 'unique_method' ELSE 'unknown' END AS tier FROM st LEFT JOIN defs d ON d.sym = to_symbol LEFT JOIN one o ON o.m = split_part(to_symbol, '.', 2) WHERE to_symbol IS NOT NULL""")
def j19_callee_resolution(spark, d):
    s = _steps(spark, d)
    defs = s.select(F.col("from_symbol").alias("sym")).where("sym is not null").distinct().withColumn("m", F.split_part("sym", F.lit("."), F.lit(2)))
    one = defs.groupBy("m").agg(F.min("sym").alias("only_sym"), F.count("*").alias("n")).where("n = 1").drop("n")
    calls = s.select(F.col("to_symbol").alias("call")).where("call is not null").distinct().withColumn("m", F.split_part("call", F.lit("."), F.lit(2)))
    j = calls.join(defs.select("sym"), F.col("call") == F.col("sym"), "left").join(one, "m", "left")
    return j.select("call", F.coalesce("sym", "only_sym").alias("target"), F.when(F.col("sym").isNotNull(), "exact").when(F.col("only_sym").isNotNull(), "unique_method").otherwise("unknown").alias("tier"))


@query(with_(LINKS, _STEPS) + """, t AS (SELECT split_part(to_symbol, '.', 1) AS class, string_agg(DISTINCT split_part(to_symbol, '.', 2), ',' ORDER BY split_part(to_symbol, '.', 2)) AS methods, count(DISTINCT split_part(to_symbol, '.', 2)) AS n FROM st WHERE to_symbol IS NOT NULL GROUP BY 1),
g AS (SELECT methods, min(class) AS interface, count(*) AS classes FROM t WHERE n >= 2 GROUP BY methods) SELECT g.interface, t.class AS implementation, g.classes FROM t JOIN g USING (methods) WHERE g.classes > 1""")
def j20_implementations(spark, d):
    """Classes that are called by the same methods, two at least: one row per class, with the first of them and how many there are."""
    t = _steps(spark, d).where("to_symbol is not null").select(F.split_part("to_symbol", F.lit("."), F.lit(1)).alias("implementation"), F.split_part("to_symbol", F.lit("."), F.lit(2)).alias("method")).distinct()
    c = t.groupBy("implementation").agg(F.array_sort(F.collect_set("method")).alias("methods")).where(F.size("methods") >= 2)
    g = c.groupBy("methods").agg(F.min("implementation").alias("interface"), F.count("*").alias("classes")).where("classes > 1")
    return c.join(g, "methods").select("interface", "implementation", "classes")


@query(with_(FACTS) + """, f AS (SELECT project_id, service, lower(operation) AS operation, entity_id, kind FROM facts WHERE operation <> '' AND kind IN ('exposure', 'dependency')), g AS (SELECT project_id, service, operation FROM f GROUP BY ALL HAVING count(DISTINCT kind) = 2) SELECT f.* FROM f JOIN g USING (project_id, service, operation)""")
def j21_shallow_connections(spark, d):
    """Entry points and dependencies of one service and operation, which are taken to be connected; one row per fact, not their pairs."""
    k = ["project_id", "service", "operation"]
    f = B.facts(spark, d).where("operation <> '' and kind in ('exposure', 'dependency')").select("project_id", "service", F.lower("operation").alias("operation"), "entity_id", "kind")
    g = f.groupBy(k).agg(F.min("kind").alias("lo"), F.max("kind").alias("hi")).where("lo < hi").select(k)
    return f.join(g, k, "left_semi")


@query(with_(FACTS, _RT) + "SELECT f.entity_id, coalesce(x.to_service, f.instance, '') AS target FROM facts f LEFT JOIN exact x USING (entity_id) WHERE f.type IN ('outbound_http', 'outbound_rpc')")
def j22_supplement_overlay(spark, d):
    f = B.facts(spark, d)
    x = S.unique_owner(S.routes(f, ("outbound_http",)), S.routes(f, ("http_route", "webhook")), "path").select("entity_id", "to_service")
    return f.where("type in ('outbound_http', 'outbound_rpc')").join(x, "entity_id", "left").select("entity_id", F.coalesce("to_service", "instance", F.lit("")).alias("target"))


@query("""WITH r AS (SELECT project_id, run_id, row_number() OVER (PARTITION BY project_id ORDER BY started_at DESC, run_id) AS n FROM graph_runs WHERE status <> 'failed'),
a AS (SELECT project_id, arg_max(run_id, n) FILTER (WHERE n = 2) AS before, arg_max(run_id, n) FILTER (WHERE n = 1) AS after FROM r GROUP BY project_id)
SELECT project_id, before, after, before IS DISTINCT FROM after AS changed FROM a""")
def j25_run_pairs(spark, d):
    """Last two good runs of each project."""
    from pyspark.sql import Window

    r = table(spark, d, "graph_runs").where("status <> 'failed'").withColumn("n", F.row_number().over(Window.partitionBy("project_id").orderBy(F.desc("started_at"), "run_id"))).where("n <= 2")
    p = r.groupBy("project_id").agg(F.max(F.when(F.col("n") == 2, F.col("run_id"))).alias("before"), F.max(F.when(F.col("n") == 1, F.col("run_id"))).alias("after"))
    return p.withColumn("changed", ~F.col("before").eqNullSafe(F.col("after")))


_J26_NAME = "regexp_replace(lower(trim({c})), '[ _-]+', '', 'g')"


@query(f"""WITH inv AS (SELECT item_id, {_J26_NAME.format(c="split_part(dns_name, '.', 1)")} AS by_dns, {_J26_NAME.format(c="regexp_extract(path, '^/([^/]+)', 1)")} AS by_path, {_J26_NAME.format(c="regexp_extract(display_name, '^([A-Za-z_ -]+)', 1)")} AS by_name FROM infra_inventory),
s AS (SELECT DISTINCT service, {_J26_NAME.format(c="service")} AS k FROM connection_clients WHERE service IS NOT NULL), hits AS (
  SELECT service, item_id, 1 AS tier FROM s JOIN inv ON k = by_dns AND k <> '' UNION ALL SELECT service, item_id, 2 FROM s JOIN inv ON k = by_path AND k <> '' UNION ALL SELECT service, item_id, 3 FROM s JOIN inv ON k = by_name AND k <> ''),
best AS (SELECT service, min(tier) AS tier FROM hits GROUP BY service), pick AS (SELECT service, tier, min(item_id) AS item_id FROM hits JOIN best USING (service, tier) GROUP BY ALL)
SELECT service, item_id, CASE tier WHEN 1 THEN 'dns' WHEN 2 THEN 'path' WHEN 3 THEN 'name' ELSE 'none' END AS matched_by FROM s LEFT JOIN pick USING (service)""")
def j26_repository_services(spark, d):
    """The deployed item of each service: by its host name first, then by its base route, then by its display name; the smallest of a tier."""
    key = lambda c: F.regexp_replace(F.lower(F.trim(c)), "[ _-]+", "")
    names = {1: F.split_part("dns_name", F.lit("."), F.lit(1)), 2: F.regexp_extract("path", "^/([^/]+)", 1), 3: F.regexp_extract("display_name", "^([A-Za-z_ -]+)", 1)}
    ways = F.array(*(F.struct(F.lit(t).alias("tier"), key(c).alias("k")) for t, c in names.items()))
    inv = table(spark, d, "infra_inventory").select("item_id", F.explode(ways).alias("w")).select("item_id", "w.*").where("k <> ''").groupBy("k").agg(F.min(F.struct("tier", "item_id")).alias("best"))
    s = table(spark, d, "connection_clients").where("service is not null").select("service").distinct().withColumn("k", key(F.col("service")))
    tier = F.col("best.tier")
    return s.join(inv, "k", "left").select("service", F.col("best.item_id").alias("item_id"), F.when(tier == 1, "dns").when(tier == 2, "path").when(tier == 3, "name").otherwise("none").alias("matched_by"))


@query(with_(FACTS, """ep AS (SELECT DISTINCT method, lower(path) AS path, endpoint_id FROM contract_fields), ex AS (SELECT entity_id, upper(d_method) AS method, lower(trim(d_path)) AS path FROM facts WHERE type = 'http_route' AND d_method IS NOT NULL)""") + "SELECT ex.entity_id, min(ep.endpoint_id) AS endpoint_id, count(*) AS n FROM ex JOIN ep USING (method, path) GROUP BY ex.entity_id")
def j27_contract_exposures(spark, d):
    ep = table(spark, d, "contract_fields").select("method", F.lower("path").alias("path"), "endpoint_id").distinct()
    ex = B.facts(spark, d).where("type = 'http_route' and d_method is not null").select("entity_id", F.upper("d_method").alias("method"), F.lower(F.trim("d_path")).alias("path"))
    return ex.join(ep, ["method", "path"]).groupBy("entity_id").agg(F.min("endpoint_id").alias("endpoint_id"), F.count("*").alias("n"))


@query(with_(B.QUEUE_ROLES, B.SUBSCRIPTIONS) + "SELECT topic, queue FROM subscriptions WHERE topic IN (SELECT queue_key FROM queue_roles) OR queue IN (SELECT queue_key FROM queue_roles)")
def j28_subscriptions(spark, d):
    """Subscription links that touch a queue which some service publishes to or consumes from, at either end."""
    q = B.queue_roles(spark, d).select("queue_key").distinct()
    links = B.subscriptions(spark, d)
    return links.join(q, links.topic == q.queue_key, "left_semi").union(links.join(q, links.queue == q.queue_key, "left_semi")).distinct()


@query(with_(CLIENTS) + r"SELECT client_id, k.target FROM clients JOIN (VALUES ('gateway', '^\$\{GATEWAY'), ('queue', 'sqs|queue'), ('cluster', '\.svc\.cluster\.local')) AS k(target, pattern) ON regexp_matches(coalesce(url_template, '') || ' ' || coalesce(host, ''), k.pattern)")
def j29_configured_targets(spark, d):
    rules = [("gateway", r"^\$\{GATEWAY"), ("queue", "sqs|queue"), ("cluster", r"\.svc\.cluster\.local")]
    text = F.concat(F.coalesce("url_template", F.lit("")), F.lit(" "), F.coalesce("host", F.lit("")))
    return B.clients(spark, d).select("client_id", F.explode(F.array_compact(F.array(*(F.when(text.rlike(p), F.lit(t)) for t, p in rules)))).alias("target"))
