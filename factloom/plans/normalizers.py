"""Scalar functions over the project's names, URLs and texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import norm as N
from factloom.operators import predicates as P
from factloom.plans import base as B
from factloom.plans.base import CLIENTS, FACTS, ORACLE, QUERIES, query, with_  # noqa: F401
from factloom.sources.tables import table


def _over(df: DataFrame, key: str, **cols: Column) -> DataFrame:
    """Distinct values of one column with functions of it."""
    return df.select(F.col(key)).where(F.col(key).isNotNull()).distinct().select(key, *(c.alias(n) for n, c in cols.items()))


def _raw(spark: SparkSession, d: str, column: str) -> DataFrame:
    return table(spark, d, "entities").select(column)


_SVC = r"regexp_replace(regexp_replace(CASE WHEN regexp_matches(s0, '^https?://') THEN regexp_replace(regexp_replace(s0, '^https?://', ''), '(.)/.*$', '\1') ELSE s0 END, '/+$', ''), '(\.svc\.cluster\.local|\.cluster\.local|\.corp\.example)$', '')"
_S0 = r"replace(regexp_replace(regexp_replace(trim(service), '^service\.', ''), '^external\.', ''), '_', '-')"


@query(rf"SELECT service, {_SVC} AS normalized FROM (SELECT DISTINCT service, {_S0} AS s0 FROM entities WHERE service IS NOT NULL)")
def f1_service_name(spark, d):
    return _over(_raw(spark, d, "service"), "service", normalized=N.service_name("service"))


@query(rf"""
WITH base AS (SELECT service, {_SVC} AS n FROM (SELECT DISTINCT service, {_S0} AS s0 FROM entities WHERE service IS NOT NULL)),
b AS (SELECT service, [n, replace(n, '_', '-'), replace(n, '-', '_'), replace(n, '.', '-'), replace(n, '.', '_'), replace(replace(n, '.', '-'), '_', '-'), replace(replace(n, '.', '_'), '-', '_')] AS l FROM base),
m AS (SELECT service, list_concat(l, flatten(list_transform(l, lambda x: [replace(x, '-', ''), replace(x, '_', ''), replace(x, '.', ''),
  CASE WHEN contains(x, 'catalogue') THEN replace(x, 'catalogue', 'catalog') WHEN contains(x, 'catalog') THEN replace(x, 'catalog', 'catalogue') ELSE '' END,
  CASE WHEN suffix(x, '-api') THEN regexp_replace(x, '-api$', '') WHEN x <> '' THEN x || '-api' ELSE '' END]))) AS l FROM b)
SELECT DISTINCT service, alias FROM (SELECT service, unnest(list_transform(l, lambda x: lower(trim(x)))) AS alias FROM m) WHERE alias <> ''""")
def f2_service_aliases(spark, d):
    return _over(_raw(spark, d, "service"), "service", a=N.service_aliases("service")).select("service", F.explode("a").alias("alias"))


@query("SELECT DISTINCT name, regexp_replace(lower(name), '[^a-z0-9_-]', '_', 'g') AS id FROM entities WHERE name IS NOT NULL")
def f3_identifier(spark, d):
    return _over(_raw(spark, d, "name"), "name", id=N.identifier("name"))


_TAIL = r"""CASE WHEN contains(q2, '://') AND trim(regexp_extract(q2, '^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/') <> ''
  THEN regexp_extract(trim(regexp_extract(q2, '^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), '([^/]+)$', 1) ELSE q2 END"""


@query(rf"""
WITH q AS (SELECT DISTINCT raw, lower(trim(trim(raw, '"'''))) AS q0 FROM (
  SELECT regexp_extract(name, '^\s*\S+\s+(.*)$', 1) AS raw FROM entities WHERE type IN ('queue_publish', 'queue_consumer', 'stream_consume')
  UNION ALL SELECT url_template FROM (SELECT instance_ref.url_template AS url_template FROM entities) WHERE url_template IS NOT NULL)),
q1 AS (SELECT raw, trim(regexp_replace(q0, '^queue:', '')) AS q1 FROM q),
q2 AS (SELECT raw, CASE WHEN regexp_matches(q1, '^arn:.*:[^:]+$') THEN regexp_extract(q1, ':([^:]+)$', 1) ELSE q1 END AS q2 FROM q1),
t AS (SELECT raw, {_TAIL} AS s FROM q2)
SELECT raw, regexp_replace(regexp_replace(s, '\.fifo$', ''), '[^a-z0-9]', '', 'g') || CASE WHEN suffix(s, '.fifo') THEN '_fifo' ELSE '' END AS graph_key,
  regexp_replace(regexp_replace(s, '\.fifo$', ''), '[-_.]+', '', 'g') AS topic,
  regexp_replace(regexp_replace(s, '\.fifo$', ''), '[-_.]+', '', 'g') || CASE WHEN suffix(s, '.fifo') THEN '.fifo' ELSE '' END AS route FROM t""")
def f4_queue_names(spark, d):
    e = table(spark, d, "entities")
    names = e.where(F.col("type").isin("queue_publish", "queue_consumer", "stream_consume")).select(F.regexp_extract("name", r"^\s*\S+\s+(.*)$", 1).alias("raw"))
    urls = e.select(F.col("instance_ref.url_template").alias("raw"))
    return _over(names.union(urls), "raw", graph_key=N.queue_key("raw"), topic=N.queue_topic("raw"), route=N.queue_route("raw"))


@query(with_(FACTS) + r"""
SELECT DISTINCT service, key, CASE WHEN key IN ('sqs','sns','kafka','queue','queues','topic','topics','queueurl','queuename','queueurls','requesturl','responseurl','sqsevent','sqsmessage','sqsmessagebody','message','messages','event','events','stream','input','output','source','destination')
   OR length(key) < 5 OR coalesce(source IN ('config_key', 'raw'), false)
  THEN regexp_replace(lower(regexp_replace(service, '[^a-z0-9]', '', 'g')), '[^a-z0-9_-]', '_', 'g') || ':' || key ELSE key END AS scoped
FROM (SELECT service, regexp_replace(lower(split_part(name, '.', 2)), '[^a-z0-9]', '', 'g') AS key, CASE WHEN ref_source = 'llm' THEN 'raw' END AS source FROM facts WHERE type IN ('queue_publish', 'queue_consumer'))""")
def f5_queue_scope(spark, d):
    q = B.facts(spark, d).where("type in ('queue_publish', 'queue_consumer')")
    key = N.queue_key(F.coalesce(F.try_element_at(F.split("name", r"\."), F.lit(2)), F.lit("")))
    q = q.select("service", key.alias("key"), F.when(F.col("ref_source") == "llm", "raw").alias("source"))
    return q.select("service", "key", N.scoped_queue(F.col("key"), F.col("service"), F.col("source")).alias("scoped")).distinct()


_PD = r"regexp_replace(trim(trim(u, '\"''')), '\$\{[^:}]+:([^}]*)\}', '\1', 'g')"
_URLP = r"regexp_extract(regexp_replace(e, '\$\{[^}]+\}', 'placeholder', 'g'), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
_ROUTES = rf"""r0 AS (SELECT DISTINCT u FROM (SELECT instance_ref.url_template AS u FROM entities UNION ALL SELECT d_path FROM facts UNION ALL SELECT contract_path FROM connection_clients) WHERE u IS NOT NULL),
r1 AS (SELECT u, {_PD} AS e FROM r0),
r2 AS (SELECT u, regexp_replace(CASE WHEN contains(e, '://') AND {_URLP} <> '' THEN {_URLP} WHEN regexp_matches(e, '^\$\{{[^}}]*\}}/') THEN regexp_replace(e, '^\$\{{[^}}]*\}}', '') ELSE e END, '\?.*$', '') AS s FROM r1),
routes AS (SELECT u, CASE WHEN prefix(s, '/') THEN s ELSE '' END AS path FROM r2)"""


def _urls(spark, d) -> DataFrame:
    return table(spark, d, "entities").select(F.col("instance_ref.url_template").alias("u")).union(B.facts(spark, d).select("d_path")).union(table(spark, d, "connection_clients").select("contract_path"))


@query(with_(FACTS, _ROUTES) + "SELECT u, path FROM routes")
def f6_route_path(spark, d):
    return _over(_urls(spark, d), "u", path=N.route_path("u"))


@query(with_(FACTS, _ROUTES) + r"""
SELECT u, CASE WHEN path = '' THEN '' WHEN n = '' THEN '/' ELSE n END AS normal FROM (
  SELECT u, path, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(path)), '\$\{[^}]+\}', '{}', 'g'), '\{[^}/]+\}', '{}', 'g'), ':[a-z_][a-z0-9_]*', '{}', 'g'), '/+', '/', 'g'), '/+$', '') AS n FROM routes)""")
def f7_route_normal(spark, d):
    return _over(_urls(spark, d), "u", normal=N.route_normal("u"))


@query(with_(FACTS) + r"""
SELECT p, CASE WHEN p = '' THEN '' WHEN length(c) > 1 THEN regexp_replace(c, '/+$', '') ELSE c END AS canonical FROM (
  SELECT p, array_to_string(list_transform(string_split(s, '/'), lambda x: CASE WHEN x IN ('*', '**') OR regexp_matches(x, '^:|^\{.*\}$|^<.*>$') THEN '{}' ELSE x END), '/') AS c FROM (
    SELECT DISTINCT p, regexp_replace(CASE WHEN prefix(p, '/') THEN p ELSE '/' || p END, '/+', '/', 'g') AS s FROM (SELECT lower(trim(regexp_extract(name, '\s(/.*)$', 1))) AS p FROM facts)))""")
def f7b_route_canonical(spark, d):
    p = B.facts(spark, d).select(N.lower(F.regexp_extract("name", r"\s(/.*)$", 1)).alias("p"))
    return _over(p, "p", canonical=N.route_canonical("p"))


@query(r"""
SELECT name, upper(regexp_extract(name, '(?i)\b(GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)\s+\S+', 1)) AS method,
  CASE WHEN prefix(p, '/') THEN regexp_replace(p, '\?.*$', '') ELSE '' END AS path
FROM (SELECT name, regexp_extract(name, '(?i)\b(?:GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)\s+(\S+)', 1) AS p FROM (SELECT DISTINCT trim(name) AS name FROM entities WHERE name IS NOT NULL))""")
def f8_method_path(spark, d):
    return _over(_raw(spark, d, "name").select(F.trim("name").alias("name")), "name", method=N.http_method("name"), path=N.http_path("name"))


@query(r"""
SELECT DISTINCT u, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(u)), '^(jdbc:)?[a-z][a-z0-9+.-]*://', ''), '[/?#].*$', ''), '^[^@]*@', ''), ':\d+$', ''),
  '(\.svc\.cluster\.local|\.cluster\.local|\.corp\.example)$', '') AS host
FROM (SELECT instance_ref.host AS u FROM connection_clients UNION ALL SELECT instance_ref.resolved_url FROM connection_clients UNION ALL SELECT address FROM infra_inventory) WHERE u IS NOT NULL""")
def f9_hostname(spark, d):
    c = table(spark, d, "connection_clients").select(F.explode(F.array("instance_ref.host", "instance_ref.resolved_url")).alias("u"))
    return _over(c.union(table(spark, d, "infra_inventory").select("address")), "u", host=N.hostname("u"))


@query(r"SELECT DISTINCT name, trim(regexp_replace(regexp_replace(replace(lower(trim(name)), '_', '-'), '[^a-z0-9/{}.:-]+', ' ', 'g'), '\s+', ' ', 'g')) AS lookup FROM entities WHERE name IS NOT NULL")
def f10_lookup(spark, d):
    return _over(_raw(spark, d, "name"), "name", lookup=N.lookup("name"))


@query(r"""SELECT DISTINCT name, regexp_matches(upper(trim(name)), '^(GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS|ANY)\s+\S') AS is_label,
  regexp_matches(replace(lower(regexp_replace(trim(name), '^service\.', '')), '_', '-'), '^(get|post|put|patch|delete|head|options|any)(-|$)') AS is_slug FROM entities WHERE name IS NOT NULL""")
def f11_method_labels(spark, d):
    slug = F.translate(F.lower(F.regexp_replace(F.trim("name"), r"^service\.", "")), "_", "-").rlike("^(get|post|put|patch|delete|head|options|any)(-|$)")
    return _over(_raw(spark, d, "name"), "name", is_label=F.upper(F.trim("name")).rlike(r"^(GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS|ANY)\s+\S"), is_slug=slug)


@query(with_(FACTS) + """SELECT entity_id, coalesce(nullif(trim(instance), ''), nullif(trim(logical_name), ''), nullif(trim(host), ''), '') AS instance,
  coalesce(CASE WHEN lower(trim(platform)) NOT IN ('', 'unknown') THEN trim(platform) END, CASE WHEN lower(trim(ref_kind)) NOT IN ('', 'unknown') THEN trim(ref_kind) END, '') AS platform FROM facts""")
def f12_first_values(spark, d):
    return B.facts(spark, d).select("entity_id", N.first_non_empty("instance", "logical_name", "host").alias("instance"), N.first_known("platform", "ref_kind").alias("platform"))


_KIND = "lower(coalesce(platform, ''))"


@query(with_(FACTS) + rf"""SELECT entity_id,
  CASE WHEN regexp_matches({_KIND}, 'postgres') THEN 'postgresql' WHEN regexp_matches({_KIND}, 's3|bucket') THEN 's3' WHEN contains({_KIND}, 'dynamo') THEN 'dynamodb' WHEN contains({_KIND}, 'redis') THEN 'redis'
    WHEN contains({_KIND}, 'athena') THEN 'athena' WHEN regexp_matches({_KIND}, 'elastic|opensearch') THEN 'elasticsearch' WHEN contains({_KIND}, 'mongo') THEN 'mongodb' ELSE {_KIND} END AS db_kind,
  CASE WHEN contains({_KIND} || ' ' || lower(coalesce(name, '')), 'redis') THEN 'redis' WHEN contains({_KIND} || ' ' || lower(coalesce(name, '')), 'memcache') THEN 'memcached' WHEN trim({_KIND}) IN ('', 'database') THEN 'cache' ELSE trim({_KIND}) END AS cache_kind,
  CASE WHEN regexp_matches(q, 'dynamodb.*stream|stream.*dynamodb') THEN 'dynamodb_stream' WHEN contains(q, 'sqs') THEN 'sqs' WHEN contains(q, 'sns') THEN 'sns' WHEN contains(q, 'kafka') THEN 'kafka'
    WHEN contains(q, 'kinesis') THEN 'kinesis' WHEN contains(q, 'rabbit') THEN 'rabbitmq' ELSE 'queue' END AS queue_kind
FROM (SELECT *, lower(coalesce(name, '') || ' ' || coalesce(type, '') || ' ' || coalesce(platform, '')) AS q FROM facts)""")
def f13_kinds(spark, d):
    return B.facts(spark, d).select("entity_id", N.db_kind("platform").alias("db_kind"), N.cache_kind("platform", "name").alias("cache_kind"), N.queue_kind("name", "type", "platform").alias("queue_kind"))


_OP = r"""CASE WHEN o = '' THEN '' WHEN regexp_matches(o, '^(read|select|find|get|list|query|search|exists|count|scan|load|fetch)') THEN 'read' WHEN regexp_matches(o, '^(delete|remove)') THEN 'delete'
  WHEN regexp_matches(o, '^(write|insert|update|save|upsert|put|merge|persist|store)') THEN 'write' WHEN regexp_matches(o, 'delete|remove|truncate') THEN 'delete'
  WHEN regexp_matches(o, 'insert|update|upsert|persist|merge') THEN 'write' WHEN regexp_matches(o, 'select|findby|fetch|search|exists|query') THEN 'read' ELSE o END"""


@query(with_(FACTS) + f"SELECT o AS label, {_OP} AS operation FROM (SELECT DISTINCT lower(trim(x)) AS o FROM (SELECT name AS x FROM facts UNION ALL SELECT operation_kind FROM facts) WHERE x IS NOT NULL)")
def f14_operations(spark, d):
    f = B.facts(spark, d).select(F.explode(F.array("name", "operation_kind")).alias("x"))
    return _over(f.select(N.lower("x").alias("label")).where("x is not null"), "label", operation=N.operation("label"))


@query(with_(FACTS) + """SELECT DISTINCT name, CASE WHEN regexp_matches(lower(name), 'insert|create|write|put|store|update|delete|upsert|evict|publish') THEN 'write'
  WHEN regexp_matches(lower(name), 'read|select|query|scan|get|find|load') THEN 'read' ELSE '' END AS direction FROM facts WHERE name IS NOT NULL""")
def f15_direction(spark, d):
    return _over(B.facts(spark, d), "name", direction=N.direction("name"))


_SING = r"""CASE WHEN length(w) < 4 OR NOT suffix(w, 's') OR w IN ('series','species','news','data','media','metadata','schema','status','alias','analysis','diagnosis','basis','index') OR regexp_matches(w, '(ss|us|is|ous)$') THEN w
  WHEN suffix(w, 'ies') AND length(w) > 4 THEN regexp_replace(w, 'ies$', 'y') WHEN suffix(w, 'ses') AND length(w) > 4 THEN regexp_replace(w, 'es$', '') ELSE regexp_replace(w, 's$', '') END"""


@query(f"SELECT w AS word, {_SING} AS singular FROM (SELECT DISTINCT lower(trim(unnest(string_split(path, '/')))) AS w FROM contract_fields WHERE path IS NOT NULL)")
def f16_singular(spark, d):
    w = table(spark, d, "contract_fields").select("path").distinct().select(F.explode(F.split("path", "/")).alias("x")).select(N.lower("x").alias("word"))
    return _over(w, "word", singular=N.singular("word"))


_PC = """CASE WHEN contains(p, 'postgres') THEN 'postgres' WHEN contains(p, 'mysql') OR contains(p, 'mariadb') THEN 'mysql' WHEN contains(p, 'dynamo') THEN 'dynamodb' WHEN contains(p, 'mongo') THEN 'mongodb'
  WHEN contains(p, 'elastic') OR contains(p, 'opensearch') THEN 'elasticsearch' WHEN contains(p, 'redis') THEN 'redis' WHEN contains(p, 'memcache') THEN 'memcached' WHEN contains(p, 'cassandra') THEN 'cassandra'
  WHEN contains(p, 'athena') THEN 'athena' WHEN contains(p, 'snowflake') THEN 'snowflake' WHEN contains(p, 'bigquery') THEN 'bigquery' WHEN p IN ('database', 'db', 'sql', 'rdbms', 'jdbc', 'relational', 'unknown') THEN '' ELSE p END"""


@query(f"SELECT p AS platform, {_PC} AS platform_class FROM (SELECT DISTINCT lower(trim(coalesce(x, ''))) AS p FROM (SELECT platform AS x FROM entities UNION ALL SELECT instance_ref.kind FROM entities))")
def f17_platform_class(spark, d):
    e = table(spark, d, "entities").select(F.explode(F.array("platform", "instance_ref.kind")).alias("x"))
    return _over(e.select(N.lower("x").alias("platform")), "platform", platform_class=N.platform_class("platform"))


@query(with_(FACTS, rf"""data AS (SELECT entity_id, type, file, lower(trim(d_table)) AS w, lower(trim(coalesce(operation_kind, ''))) AS o, lower(trim(coalesce(platform, ''))) AS p FROM facts WHERE type IN ('db_operation', 'cache_operation') AND trim(coalesce(d_table, '')) <> ''),
http AS (SELECT entity_id, type, file, lower(trim(coalesce(d_method, regexp_extract(name, '^(\S+)\s', 1)))) AS m, lower(trim(coalesce(d_path, regexp_extract(name, '\s(/.*)$', 1)))) AS pth FROM facts WHERE type IN ('http_route', 'webhook', 'outbound_http')),
keys AS (
  SELECT entity_id, type || '|' || {_SING} || '|' || {_OP} || '|' || {_PC} AS strict, type || '|' || {_SING} || '|' || {_OP} || '|' || {_PC} AS loose FROM data
  UNION ALL
  SELECT entity_id, type || '|' || m || '|' || c || '|' || coalesce(file, ''), type || '|' || m || '|' || c || '|' FROM (
    SELECT *, CASE WHEN pth = '' THEN '' WHEN length(c0) > 1 THEN regexp_replace(c0, '/+$', '') ELSE c0 END AS c FROM (
      SELECT *, array_to_string(list_transform(string_split(regexp_replace(CASE WHEN prefix(pth, '/') THEN pth ELSE '/' || pth END, '/+', '/', 'g'), '/'), lambda x: CASE WHEN x IN ('*', '**') OR regexp_matches(x, '^:|^\{{.*\}}$|^<.*>$') THEN '{{}}' ELSE x END), '/') AS c0 FROM http)))""") + "SELECT * FROM keys")
def f18_semantic_keys(spark, d):
    f = B.facts(spark, d)
    data = f.where("type in ('db_operation', 'cache_operation') and trim(coalesce(d_table, '')) <> ''")
    key = F.concat_ws("|", "type", N.singular("d_table"), N.operation("operation_kind"), N.platform_class("platform"))
    http = f.where("type in ('http_route', 'webhook', 'outbound_http')")
    method = N.lower(F.coalesce("d_method", F.regexp_extract("name", r"^(\S+)\s", 1)))
    path = N.route_canonical(F.coalesce("d_path", F.regexp_extract("name", r"\s(/.*)$", 1)))
    return data.select("entity_id", key.alias("strict"), key.alias("loose")).union(
        http.select("entity_id", F.concat_ws("|", "type", method, path, F.coalesce("file", F.lit(""))), F.concat_ws("|", "type", method, path, F.lit(""))))


@query(with_(FACTS) + r"SELECT DISTINCT q AS queue, regexp_replace(regexp_replace(lower(trim(q)), '[-_.](consumer|listener)$', ''), '[-_.]+$', '') AS destination FROM (SELECT regexp_extract(name, '^\S+\s+(.*)$', 1) AS q FROM facts WHERE type IN ('queue_consumer', 'stream_consume'))")
def f19_queue_destination(spark, d):
    q = B.facts(spark, d).where("type in ('queue_consumer', 'stream_consume')").select(F.regexp_extract("name", r"^\S+\s+(.*)$", 1).alias("queue"))
    return _over(q, "queue", destination=N.queue_destination("queue"))


@query(with_(FACTS) + r"""SELECT entity_id, CASE WHEN coalesce(db_name, '') <> '' THEN 'datasource:' || lower(trim(db_name)) WHEN coalesce(host, '') <> '' THEN 'host:' || lower(trim(host))
  WHEN lower(trim(coalesce(instance, ''))) NOT IN ('', 'default', 'primary', 'main', 'db', 'database', 'datasource') THEN 'instance:' || lower(trim(instance)) ELSE 'service:' || service || ':' || lower(trim(coalesce(d_table, name))) END AS identity
FROM facts WHERE type = 'db_operation'""")
def f20_db_identity(spark, d):
    f = B.facts(spark, d).where("type = 'db_operation'")
    generic = N.lower("instance").isin("", "default", "primary", "main", "db", "database", "datasource")
    return f.select("entity_id", F.when(F.coalesce("db_name", F.lit("")) != "", F.concat(F.lit("datasource:"), N.lower("db_name"))).when(F.coalesce("host", F.lit("")) != "", F.concat(F.lit("host:"), N.lower("host")))
                    .when(~generic, F.concat(F.lit("instance:"), N.lower("instance"))).otherwise(F.concat(F.lit("service:"), F.col("service"), F.lit(":"), N.lower(F.coalesce("d_table", "name")))).alias("identity"))


@query(with_(CLIENTS) + r"""SELECT client_id, pos, split_part(inner_text, ':', 1) AS variable, CASE WHEN contains(inner_text, ':') THEN substr(inner_text, strpos(inner_text, ':') + 1) END AS fallback,
  regexp_matches(split_part(inner_text, ':', 1), '^[A-Z][A-Z0-9_]*$') AS is_env FROM (
  SELECT client_id, generate_subscripts(l, 1) AS pos, unnest(l) AS inner_text FROM (SELECT client_id, regexp_extract_all(url_template, '\$\{([^}]*)\}', 1) AS l FROM clients WHERE url_template IS NOT NULL))""")
def f21_placeholders(spark, d):
    c = B.clients(spark, d).select("client_id", F.posexplode(F.regexp_extract_all("url_template", F.lit(r"\$\{([^}]*)\}"), F.lit(1))).alias("p", "t"))
    name = F.split_part("t", F.lit(":"), F.lit(1))
    return c.select("client_id", (F.col("p") + 1).cast("bigint").alias("pos"), name.alias("variable"), F.when(F.contains("t", F.lit(":")), F.expr("substr(t, instr(t, ':') + 1)")).alias("fallback"), name.rlike("^[A-Z][A-Z0-9_]*$").alias("is_env"))


@query(with_(CLIENTS) + r"""SELECT u, CASE WHEN length(regexp_replace(s, '[^A-Za-z]', '', 'g')) >= 4 THEN s ELSE '' END AS static FROM (
  SELECT DISTINCT url_template AS u, trim(regexp_replace(regexp_replace(url_template, '\{\{[^}]*\}\}|\$\{[^}]*\}', '', 'g'), '[-_./]{2,}', '-', 'g'), '-_./') AS s FROM clients WHERE url_template IS NOT NULL)""")
def f22_static_suffix(spark, d):
    return _over(B.clients(spark, d).select(F.col("url_template").alias("u")), "u", static=N.static_suffix("u"))


@query(with_(CLIENTS) + r"SELECT DISTINCT config_source AS key, regexp_extract(regexp_replace(trim(config_source), '[?#].*$', ''), '([^/:.]+)[/:.]*$', 1) AS segment FROM clients WHERE config_source IS NOT NULL")
def f23_last_segment(spark, d):
    return _over(B.clients(spark, d).select(F.col("config_source").alias("key")), "key", segment=N.last_segment("key"))


_PROFILE = r"""CASE WHEN f IN ('default', 'base', 'common', 'application', 'values') THEN '' ELSE f END"""
_PROFILE_F = r"""coalesce(nullif(regexp_extract(p, 'application-([a-z0-9]+)\.', 1), ''), nullif(regexp_extract(p, '\.env\.([a-z0-9]+)$', 1), ''), nullif(regexp_extract(p, '(?:env|deploy|config|environments?)/([a-z0-9]+)(?:\.|/)', 1), ''), '')"""


@query(with_(CLIENTS) + f"SELECT k AS key, {_PROFILE} AS profile FROM (SELECT k, {_PROFILE_F} AS f FROM (SELECT DISTINCT config_source AS k, regexp_replace(lower(trim(config_source)), ':.*$', '') AS p FROM clients WHERE config_source IS NOT NULL))")
def f24_config_profile(spark, d):
    return _over(B.clients(spark, d).select(F.col("config_source").alias("key")), "key", profile=N.config_profile("key"))


@query(r"""SELECT sql, upper(regexp_extract(sql, '(?i)^\s*(select|insert|update|delete|merge)', 1)) AS statement, lower(regexp_extract(sql, '(?i)\b(?:from|into|update|join)\s+([A-Za-z_][A-Za-z0-9_.]*)', 1)) AS main_table,
  regexp_extract(sql, '(?i)^\s*select\s+(.*?)\s+from\b', 1) AS columns FROM (SELECT DISTINCT trim(unnest(regexp_extract_all(text, '(?m)^SELECT [^\n]+$'))) AS sql FROM documents WHERE text IS NOT NULL)""")
def f25_sql_statements(spark, d):
    s = table(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"(?m)^SELECT [^\n]+$"), F.lit(0))).alias("s")).select(F.trim("s").alias("sql"))
    part = lambda r: F.regexp_extract("sql", r, 1)
    return _over(s, "sql", statement=F.upper(part(r"(?i)^\s*(select|insert|update|delete|merge)")), main_table=F.lower(part(r"(?i)\b(?:from|into|update|join)\s+([A-Za-z_][A-Za-z0-9_.]*)")), columns=part(r"(?i)^\s*select\s+(.*?)\s+from\b"))


@query(r"""SELECT name, s AS snake, CASE WHEN s = '' THEN s WHEN regexp_matches(s, '[^aeiou]y$') THEN regexp_replace(s, 'y$', 'ies') WHEN regexp_matches(s, '(s|x|z|ch|sh)$') THEN s || 'es' ELSE s || 's' END AS plural,
  array_to_string(string_split(s, '_'), ' ') AS tokens FROM (SELECT name, lower(regexp_replace(regexp_replace(regexp_replace(name, '([A-Z]+)([A-Z][a-z])', '\1_\2', 'g'), '([a-z0-9])([A-Z])', '\1_\2', 'g'), '[\s.-]+', '_', 'g')) AS s FROM (SELECT DISTINCT name FROM contract_fields WHERE name IS NOT NULL))""")
def f26_case_helpers(spark, d):
    s = table(spark, d, "contract_fields").select("name").where("name is not null").distinct().withColumn("snake", N.snake("name"))
    return s.select("name", "snake", N.plural(F.col("snake")).alias("plural"), F.array_join(F.split("snake", "_"), " ").alias("tokens"))


@query(with_(FACTS) + "SELECT entity_id, sha256(concat_ws('|', project_id, type, service, name)) AS stable_id FROM facts")
def f27_stable_ids(spark, d):
    return B.facts(spark, d).select("entity_id", F.sha2(F.concat_ws("|", "project_id", "type", "service", "name"), 256).alias("stable_id"))


@query(r"""SELECT v AS version, CAST(split_part(v, '.', 1) AS INT) AS major, CAST(split_part(v, '.', 2) AS INT) AS minor, CAST(split_part(v, '.', 3) AS INT) AS patch,
  CAST(split_part(v, '.', 1) AS INT) = 5 AND CAST(split_part(v, '.', 2) AS INT) >= 2 AS compatible
FROM (SELECT DISTINCT unnest(regexp_extract_all(text, 'version (\d+\.\d+\.\d+)', 1)) AS v FROM documents WHERE text IS NOT NULL)""")
def f28_semver(spark, d):
    v = table(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"version (\d+\.\d+\.\d+)"), F.lit(1))).alias("version")).distinct()
    part = [F.split_part("version", F.lit("."), F.lit(i)).cast("int") for i in (1, 2, 3)]
    v = v.select("version", *(p.alias(n) for p, n in zip(part, ("major", "minor", "patch"))))
    return v.select("*", ((F.col("major") == 5) & (F.col("minor") >= 2)).alias("compatible"))


@query("SELECT DISTINCT type, CASE WHEN contains(t, 'http') THEN 'http' WHEN contains(t, 'rpc') THEN 'rpc' WHEN regexp_matches(t, 'queue|stream') THEN 'queue' WHEN regexp_matches(t, 'db|cache') THEN 'shared_db' ELSE 'other' END AS match_type FROM (SELECT type, lower(trim(type)) AS t FROM entities)")
def f29_match_type(spark, d):
    return _over(_raw(spark, d, "type"), "type", match_type=N.match_type("type"))


_NONE = ", ".join(f"'{x}'" for x in P.NO_TARGETS)
_USEFUL = lambda c: f"CASE WHEN lower(trim({c})) NOT IN ({_NONE}) THEN trim({c}) END"
_DETAILS = ", ".join(_USEFUL(f"(CASE WHEN json_type(j, '$.{k}') = 'VARCHAR' THEN j->>'$.{k}' END)") for k in P.TARGET_DETAILS)
_ANY = lambda x, parts: "(" + " OR ".join(f"contains({x}, '{p}')" for p in parts) + ")"


@query(f"""SELECT entity_id, coalesce({_USEFUL('instance')}, {_DETAILS}, list_filter(tags, lambda t: {_ANY('t', P.TARGET_TAGS)})[1],
  list_filter(list_transform(flatten(list_transform(evidence, lambda e: string_split_regex(coalesce(e.snippet, ''), '\\s+'))), lambda w: trim(w, '"''(){{}},;`')), lambda w: {_ANY('w', P.TARGET_WORDS)})[1], trim(name)) AS target
FROM (SELECT DISTINCT ON (entity_id) *, TRY_CAST(details AS JSON) AS j FROM entities WHERE deleted_at IS NULL AND kind = 'dependency')""")
def f30_target_ladder(spark, d):
    """What each dependency points to: instance, details, tags, words of the evidence, name."""
    e = table(spark, d, "entities").where("deleted_at is null and kind = 'dependency'").select("entity_id", "instance", "details", "tags", "evidence", "name").dropDuplicates(["entity_id"])
    return e.select("entity_id", P.target(e).alias("target"))


@query(r"""SELECT attempt_no, CAST(power(2, least(attempt_no, 6)) AS BIGINT) AS backoff_s, round(greatest(least(0.98 - 0.04 * (attempt_no - 1), 0.99), 0.5), 6) AS path_score FROM (SELECT DISTINCT attempt_no FROM job_attempts WHERE attempt_no IS NOT NULL)""")
def fm_scores(spark, d):
    a = table(spark, d, "job_attempts").select("attempt_no").where("attempt_no is not null").distinct()
    score = F.greatest(F.least(F.lit(0.98) - F.lit(0.04) * (F.col("attempt_no") - 1), F.lit(0.99)), F.lit(0.5))
    return a.select("attempt_no", F.pow(F.lit(2), F.least("attempt_no", F.lit(6))).cast("bigint").alias("backoff_s"), F.round(score, 6).alias("path_score"))


@query("SELECT run_id, strftime(started_at, '%Y-%m-%dT%H:%M:%S.%fZ') AS started, CAST(epoch_us(finished_at) - epoch_us(started_at) AS BIGINT) AS took_us, finished_at < TIMESTAMP '2025-06-01' AS due FROM graph_runs")
def fd_timestamps(spark, d):
    r = table(spark, d, "graph_runs")
    return r.select("run_id", F.date_format("started_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("started"), (F.unix_micros("finished_at") - F.unix_micros("started_at")).alias("took_us"), (F.col("finished_at") < F.lit("2025-06-01").cast("timestamp")).alias("due"))
