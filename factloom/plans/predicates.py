"""Filters, predicates and projections over the project's facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import norm as N
from factloom.operators import packs
from factloom.operators import predicates as P
from factloom.plans import base as B
from factloom.plans.base import CLIENTS, FACTS, LINKS, ORACLE, QUERIES, query, with_  # noqa: F401
from factloom.plans.normalizers import _OP, _PC
from factloom.sources.tables import table

_o = lambda c: _OP.replace("(o,", f"(lower(trim(coalesce({c}, ''))),").replace("WHEN o = ''", f"WHEN lower(trim(coalesce({c}, ''))) = ''").replace("ELSE o END", f"ELSE lower(trim(coalesce({c}, ''))) END")


@query(with_(FACTS) + """SELECT entity_id, CASE WHEN trim(coalesce(name, '')) = '' THEN 'missing_name' WHEN trim(coalesce(type, '')) = '' THEN 'missing_type' WHEN confidence IS NULL THEN 'missing_confidence'
  WHEN confidence < 0.7 THEN 'low_confidence' WHEN n_locations = 0 THEN 'missing_location' END AS reason FROM facts""")
def pr1_entity_gate(spark, d):
    return P.gate(B.facts(spark, d)).select("entity_id", "reason")


_ALIASES = " ".join(f"WHEN '{k}/{x}' THEN '{y}'" for k, m in P.TYPE_ALIASES.items() for x, y in m.items())


@query(f"SELECT DISTINCT kind, type, coalesce(CASE coalesce(kind, '') || '/' || t {_ALIASES} END, t) AS type_name FROM (SELECT kind, type, regexp_replace(lower(trim(type)), '[ -]', '_', 'g') AS t FROM (SELECT kind, type FROM entities UNION ALL SELECT 'dependency', kind FROM connection_clients))")
def pr2_type_names(spark, d):
    """Fact types, and the kinds of clients, by their usual names."""
    t = table(spark, d, "entities").select("kind", "type").union(table(spark, d, "connection_clients").select(F.lit("dependency"), "kind")).distinct()
    return t.select("kind", "type", P.type_name(F.col("kind"), F.col("type")).alias("type_name"))


@query(with_(FACTS) + rf"""SELECT entity_id, {_PC} AS platform, coalesce(nullif(trim(instance), ''), nullif(trim(logical_name), ''), nullif(trim(host), ''), '') AS instance,
  trim(CASE WHEN type IN ('http_route', 'webhook', 'outbound_http') THEN upper(trim(coalesce(d_method, ''))) || ' ' || trim(coalesce(d_path, '')) WHEN type IN ('db_operation', 'cache_operation') THEN {_o('operation_kind')} || ' ' || lower(trim(coalesce(d_table, '')))
    WHEN type IN ('queue_publish', 'queue_consumer', 'stream_consume') THEN regexp_extract(name, '\s(.*)$', 1) ELSE name END) AS operation,
  CASE WHEN type IN ('db_operation', 'cache_operation') THEN {_o('operation_kind')} WHEN type = 'queue_publish' THEN 'publish' WHEN type IN ('queue_consumer', 'stream_consume') THEN 'consume'
    WHEN type IN ('http_route', 'webhook', 'rpc_endpoint') THEN 'serve' WHEN prefix(type, 'outbound') THEN 'call' ELSE 'run' END AS operation_kind
FROM (SELECT *, lower(coalesce(CASE WHEN lower(trim(platform)) NOT IN ('', 'unknown') THEN trim(platform) END, CASE WHEN lower(trim(ref_kind)) NOT IN ('', 'unknown') THEN trim(ref_kind) END, '')) AS p FROM facts)""")
def pr3_grouping(spark, d):
    return P.grouping(B.facts(spark, d))


@query(with_(FACTS) + r"""SELECT entity_id, concat_ws(',', CASE WHEN type IN ('http_route', 'webhook', 'outbound_http') AND coalesce(d_method, '') = '' THEN 'method' END, CASE WHEN type IN ('http_route', 'webhook', 'outbound_http') AND coalesce(d_path, '') = '' THEN 'path' END,
    CASE WHEN type = 'db_operation' AND coalesce(d_table, '') = '' THEN 'table' END) AS missing,
  coalesce(nullif(d_method, ''), upper(regexp_extract(name, '(?i)\b(GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)\s+\S+', 1))) AS method, coalesce(nullif(d_path, ''), regexp_extract(name, '\s(/\S*)', 1)) AS path,
  coalesce(nullif(d_table, ''), CASE WHEN type = 'db_operation' THEN lower(regexp_extract(name, '^\S+\s+(\S+)', 1)) ELSE '' END) AS resource FROM facts""")
def pr4_required_details(spark, d):
    f, t = B.facts(spark, d), F.col("type")
    missing = [F.when(t.isin([k for k, v in P.REQUIRED.items() if m in v]) & (F.coalesce(f"d_{m}", F.lit("")) == ""), m) for m in ("method", "path", "table")]
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    return f.select("entity_id", F.concat_ws(",", *missing).alias("missing"), F.coalesce(blank("d_method"), N.http_method("name")).alias("method"), F.coalesce(blank("d_path"), F.regexp_extract("name", r"\s(/\S*)", 1)).alias("path"),
                    F.coalesce(blank("d_table"), F.when(t == "db_operation", F.lower(F.regexp_extract("name", r"^\S+\s+(\S+)", 1))).otherwise("")).alias("resource"))


@query(with_(FACTS) + "SELECT entity_id, kind, type, service, name, confidence, CAST(n_evidence AS INT) AS evidence, CAST(n_locations AS INT) AS locations FROM facts")
def pr5_overview(spark, d):
    return B.facts(spark, d).select("entity_id", "kind", "type", "service", "name", "confidence", F.col("n_evidence").alias("evidence"), F.col("n_locations").alias("locations"))


@query(with_(FACTS) + "SELECT entity_id AS id, coalesce(nullif(trim(operation_kind), ''), kind) AS kind, name, coalesce(summary, '') AS summary FROM facts")
def pr6_entity_summary(spark, d):
    return B.facts(spark, d).select(F.col("entity_id").alias("id"), F.coalesce(F.nullif(F.trim("operation_kind"), F.lit("")), F.col("kind")).alias("kind"), "name", F.coalesce("summary", F.lit("")).alias("summary"))


@query(with_(FACTS) + r"""SELECT entity_id, coalesce(CASE WHEN h <> '' AND NOT regexp_matches(h, '[\s{}<>`$]') THEN h END, CASE WHEN l <> '' AND NOT regexp_matches(l, '[\s{}<>`$]') THEN l END, CASE WHEN i <> '' AND NOT regexp_matches(i, '[\s{}<>`$]') THEN i END, '') AS target
FROM (SELECT entity_id, lower(trim(coalesce(host, ''))) AS h, lower(trim(coalesce(logical_name, ''))) AS l, lower(trim(coalesce(instance, ''))) AS i FROM facts WHERE type = 'outbound_http')""")
def pr7_http_target(spark, d):
    usable = [F.when((N.lower(c) != "") & ~N.lower(c).rlike(r"[\s{}<>`$]"), N.lower(c)) for c in ("host", "logical_name", "instance")]
    return B.facts(spark, d).where("type = 'outbound_http'").select("entity_id", F.coalesce(*usable, F.lit("")).alias("target"))


@query(with_(FACTS) + r"""SELECT entity_id, coalesce(host, '') = '' AND (coalesce(url_template, '') = '' OR regexp_matches(url_template, '^\$\{[^:}]*\}')) OR coalesce(contains(lower(logical_name), 'client'), false) AS unresolved FROM facts WHERE type IN ('outbound_http', 'outbound_rpc')""")
def pr8_unresolved_flag(spark, d):
    f = B.facts(spark, d).where("type in ('outbound_http', 'outbound_rpc')")
    u = F.coalesce("url_template", F.lit(""))
    return f.select("entity_id", ((F.coalesce("host", F.lit("")) == "") & ((u == "") | u.rlike(r"^\$\{[^:}]*\}")) | F.coalesce(F.contains(F.lower("logical_name"), F.lit("client")), F.lit(False))).alias("unresolved"))


@query(with_(FACTS) + r"SELECT entity_id, d_table FROM facts WHERE kind = 'dependency' AND NOT (type IN ('db_operation', 'cache_operation') AND (lower(trim(coalesce(nullif(trim(d_table), ''), name))) = 'entity_manager' OR regexp_matches(regexp_extract(lower(coalesce(nullif(trim(d_table), ''), name)), '([^.]*)$', 1), '_(seq|sequence)$')))")
def pr9_junk_filter(spark, d):
    return P.drop_junk(B.facts(spark, d).where("kind = 'dependency'")).select("entity_id", "d_table")


@query(with_(FACTS) + """, u AS (SELECT project_id, service, bool_or(type = 'queue_publish' AND lower(coalesce(platform, '')) = 'sqs') AS sqs,
  bool_or(type = 'db_operation' AND (lower(coalesce(platform, '')) = 'athena' OR contains(lower(name), 'athena'))) AS athena FROM facts WHERE kind = 'dependency' GROUP BY ALL)
SELECT f.entity_id, f.type FROM facts f JOIN u USING (project_id, service) WHERE kind = 'dependency' AND NOT (f.type = 'outbound_http' AND (
  (u.sqs AND (lower(coalesce(platform, '')) = 'sqs' OR contains(lower(name), 'sqs') OR contains(lower(coalesce(operation, '')), 'sendmessage')))
  OR (u.athena AND (lower(coalesce(platform, '')) = 'athena' OR contains(lower(name), 'athena') OR contains(lower(coalesce(operation, '')), 'athena')))))""")
def pr10_transport_duplicates(spark, d):
    return P.drop_transport_duplicates(B.facts(spark, d).where("kind = 'dependency'")).select("entity_id", "type")


@query(with_(FACTS) + """SELECT entity_id, type FROM facts f WHERE kind = 'exposure' AND NOT (type = 'cli_command' AND coalesce(file, '') <> '' AND EXISTS (SELECT 1 FROM facts j WHERE j.type = 'scheduled_job' AND j.service = f.service AND j.file = f.file))""")
def pr11_job_entrypoints(spark, d):
    return P.collapse_job_entrypoints(B.facts(spark, d).where("kind = 'exposure'")).select("entity_id", "type")


@query(with_(LINKS) + rf"""SELECT symbol, kind_word, resource, CASE WHEN {_o('kind_word')} <> '' AND resource <> '' AND resource <> lower(symbol) AND regexp_matches(symbol, '^[^ ]+\.[^ ]+$') THEN {_o('kind_word')} || ' ' || resource ELSE symbol END AS data_name
FROM (SELECT DISTINCT s.to_symbol AS symbol, s.action AS kind_word, lower(split_part(s.to_symbol, '.', 1)) AS resource FROM (SELECT unnest(p.steps) AS s FROM (SELECT unnest(paths) AS p FROM links)) WHERE s.to_symbol IS NOT NULL)""")
def pr12_data_names(spark, d):
    s = B.links(spark, d).select(F.explode("paths").alias("p")).select(F.explode("p.steps").alias("s")).where("s.to_symbol is not null")
    s = s.select(F.col("s.to_symbol").alias("symbol"), F.col("s.action").alias("kind_word"), F.lower(F.split_part("s.to_symbol", F.lit("."), F.lit(1))).alias("resource")).distinct()
    return s.select("*", P.data_name(F.col("symbol"), F.col("resource"), F.col("kind_word")).alias("data_name"))


@query(with_(FACTS) + "SELECT entity_id, plugin_source FROM facts WHERE coalesce(plugin_source, '') NOT IN ('pack/company')")
def pr13_detector_filter(spark, d):
    deny = ["pack/company"]
    return B.facts(spark, d).where(~F.coalesce("plugin_source", F.lit("")).isin(deny)).select("entity_id", "plugin_source")


#: Packs of the tables' own conventions: where they apply, what they extract, how it resolves.
PACKS = [packs.parse(x) for x in (
    {"id": "terraform", "applies_to": {"has_file": ["**/*.tf"]}},
    {"id": "spring", "priority": 5, "applies_to": {"has_file": ["**/*.java"], "name": "[a-m]*"}},
    {"id": "node", "applies_to": {"has_file": ["**/*.ts", "**/package.json"]}},
    {"id": "fields", "priority": 10, "extractions": [{"strategy": "field_path", "path": "query_params.*.name", "target": "query_parameter"}, {"strategy": "field_path", "path": "metadata.rev", "target": "revision"}]},
    {"id": "tickets", "extractions": [{"strategy": "regex", "pattern": r"\b(OPS-\d+|CHG\d+)\b", "target": "ticket"}, {"strategy": "regex", "pattern": r"\b(\w+)\.corp\.example\b", "target": "host"}]},
)]


@query(with_(FACTS) + r"""SELECT DISTINCT f.service, k.pack_id FROM facts f JOIN (VALUES ('terraform', '\.tf$', ''), ('spring', '\.java$', '^[a-m][^/]*$'), ('node', '\.ts$|(^|/)package\.json$', '')) AS k(pack_id, file_like, name_like)
  ON regexp_matches(coalesce(f.file, ''), k.file_like) AND (k.name_like = '' OR regexp_matches(f.service, k.name_like))""")
def pr14_pack_applicability(spark, d):
    """Which packs apply to which service, by its files and its name."""
    f = B.facts(spark, d).select("service", F.coalesce("file", F.lit("")).alias("path"))
    return packs.applicable(f, [p for p in PACKS if p.files])


@query(with_(FACTS) + r"SELECT DISTINCT file, regexp_matches(file, '^deploy/[^/]*/[^/]*\.yml$') AS deploy_yml, regexp_matches(file, '^(?:.*/)?[^/]*\.go$') AS any_go, regexp_matches(file, '^src/.*$') AS under_src FROM facts WHERE file IS NOT NULL")
def pr15_globs(spark, d):
    f = B.facts(spark, d).select("file").where("file is not null").distinct()
    return f.select("file", *(F.col("file").rlike(P.glob_regex(g)).alias(n) for n, g in (("deploy_yml", "deploy/*/*.yml"), ("any_go", "**/*.go"), ("under_src", "src/**"))))


@query("""WITH e AS (SELECT DISTINCT entity_id, TRY_CAST(details AS JSON) AS d FROM entities WHERE details IS NOT NULL)
SELECT DISTINCT entity_id, 'query_parameter' AS target, j->>'$.name' AS value FROM (SELECT entity_id, unnest(CASE WHEN json_type(d, '$.query_params') = 'ARRAY' THEN (d->'$.query_params')::JSON[] ELSE [] END) AS j FROM e) WHERE j->>'$.name' IS NOT NULL
UNION SELECT entity_id, 'revision', d->>'$.metadata.rev' FROM e WHERE d->>'$.metadata.rev' IS NOT NULL""")
def pr16_field_path(spark, d):
    """What a pack reads from the details by field paths."""
    e = table(spark, d, "entities").where("details is not null").select(F.col("entity_id").alias("path"), F.col("details").alias("text"))
    return packs.extract(e, [p for p in PACKS if p.id == "fields"]).select(F.col("path").alias("entity_id"), "target", "value")


@query(r"""SELECT DISTINCT doc_id, 'ticket' AS target, unnest(regexp_extract_all(text, '\b(OPS-\d+|CHG\d+)\b', 1)) AS value FROM documents WHERE text IS NOT NULL
UNION SELECT doc_id, 'host', unnest(regexp_extract_all(text, '\b(\w+)\.corp\.example\b', 1)) FROM documents WHERE text IS NOT NULL""")
def pr17_regex_extraction(spark, d):
    """What a pack reads from texts by expressions."""
    t = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("path"), "text")
    return packs.extract(t, [p for p in PACKS if p.id == "tickets"]).select(F.col("path").cast("bigint").alias("doc_id"), "target", "value")


@query(with_(CLIENTS) + r"SELECT DISTINCT url_template AS target, url_template <> '' AND NOT regexp_matches(url_template, '[\s{}<>`$]') AS is_literal FROM clients WHERE url_template IS NOT NULL")
def pr18_literal_target(spark, d):
    u = B.clients(spark, d).select(F.col("url_template").alias("target")).where("target is not null").distinct()
    return u.select("target", ((F.col("target") != "") & ~F.col("target").rlike(r"[\s{}<>`$]")).alias("is_literal"))


@query(with_(CLIENTS) + r"""SELECT DISTINCT u AS url, regexp_extract(u, '^([a-z][a-z0-9+.-]*)://', 1) AS scheme, regexp_extract(u, '://(?:[^@/?#]*@)?([^/?#:]*)', 1) AS host,
  regexp_matches(u, '^https?://[^@/?#\s]+(/[^?#\s]*)?$') AS valid FROM (SELECT url_template AS u FROM clients WHERE url_template IS NOT NULL AND contains(url_template, '://'))""")
def pr19_detected_target(spark, d):
    u = B.clients(spark, d).select(F.col("url_template").alias("url")).where("contains(url, '://')").distinct()
    return u.select("url", F.regexp_extract("url", r"^([a-z][a-z0-9+.-]*)://", 1).alias("scheme"), F.regexp_extract("url", r"://(?:[^@/?#]*@)?([^/?#:]*)", 1).alias("host"), F.col("url").rlike(r"^https?://[^@/?#\s]+(/[^?#\s]*)?$").alias("valid"))


@query(r"SELECT doc_id, CAST(length(p) - length(replace(p, chr(10), '')) + 1 AS INT) AS line FROM (SELECT doc_id, split_part(text, 'Consumers of', 1) AS p FROM documents WHERE contains(text, 'Consumers of'))")
def pr20_line_numbers(spark, d):
    """Line of the first hit of a phrase."""
    p = F.split_part("text", F.lit("Consumers of"), F.lit(1))
    return table(spark, d, "documents").where(F.contains("text", F.lit("Consumers of"))).select("doc_id", F.size(F.split(p, "\n")).alias("line"))


@query(with_(FACTS) + r"""SELECT DISTINCT file, NOT regexp_matches(file, '(^|/)(tests?|__tests__|testdata|fixtures?|mocks?|spec|examples?)(/|$)|(_test\.|\.test\.|\.spec\.|Test\.java$|Tests\.java$)') AND NOT regexp_matches(file, '\.(ya?ml|json|toml|properties|env|tf|ini)$') AS production FROM facts WHERE file IS NOT NULL""")
def pr21_production_paths(spark, d):
    f = B.facts(spark, d).select("file").where("file is not null").distinct()
    return f.select("file", (~F.col("file").rlike(P.TEST_LIKE) & ~F.col("file").rlike(P.CONFIG_LIKE)).alias("production"))


_NEGATIVE = "(" + " OR ".join(f"prefix(s, '{x}')" for x in P.NO_RESULT_BEGINNINGS) + ") AND (" + " OR ".join(f"contains(s, '{x}')" for x in P.NO_RESULT_WORDS) + ")"


@query(with_(FACTS) + f"""SELECT entity_id, c IN ({', '.join(f"'{x}'" for x in P.NO_RESULT_NAMES)}) OR (prefix(c, 'no') AND suffix(c, 'found')) OR ({_NEGATIVE} AND (c = t OR c IN ('noop', 'nooperation') OR {' OR '.join(f"contains(c, '{x}')" for x in P.NO_RESULT_PARTS)})) AS says_nothing
FROM (SELECT entity_id, regexp_replace(lower(trim(coalesce(name, ''))), '[ _./-]', '', 'g') AS c, regexp_replace(lower(coalesce(type, '')), '_', '', 'g') AS t, lower(trim(coalesce(summary, ''))) AS s FROM facts)""")
def pr22_no_result(spark, d):
    """Facts that only say that nothing was found."""
    return B.facts(spark, d).select("entity_id", P.says_nothing(F.col("name"), F.col("type"), F.col("summary")).alias("says_nothing"))


def sql_text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_CHANGED = "CASE " + " ".join(f"WHEN regexp_matches(f, {sql_text(rx)}) THEN '{c}'" for c, rx in P.category_patterns()) + f" ELSE '{P.OTHER_CATEGORY}' END"
_SAYS = {k: " OR ".join(f"contains(t, {sql_text(x)})" for x in v) for k, v in P.PATCH_SIGNALS.items()}


@query(with_(FACTS) + f"SELECT file, {_CHANGED} AS category FROM (SELECT DISTINCT file, lower(file) AS f FROM facts WHERE file IS NOT NULL)")
def pr23_changed_files(spark, d):
    f = B.facts(spark, d).select("file").where("file is not null").distinct()
    return f.select("file", P.changed_file_kind(F.col("file")).alias("category"))


_SIGNALS = ", ".join([*(f"CASE WHEN c = '{c}' THEN '{x}' END" for c, x in P.CATEGORY_SIGNALS.items()), *(f"CASE WHEN {says} THEN '{x}' END" for x, says in _SAYS.items())])


@query(rf"""SELECT DISTINCT entity_id, file, unnest(list_filter([{_SIGNALS}], lambda x: x IS NOT NULL)) AS signal
FROM (SELECT entity_id, file, t, {_CHANGED} AS c FROM (SELECT entity_id, e.location.file AS file, lower(e.location.file) AS f, lower(coalesce(e.snippet, '')) AS t FROM (SELECT entity_id, unnest(evidence) AS e FROM entities)))""")
def pr24_patch_signals(spark, d):
    e = table(spark, d, "entities").select("entity_id", F.explode("evidence").alias("e")).select("entity_id", F.col("e.location.file").alias("file"), F.col("e.snippet").alias("t"))
    return e.select("entity_id", "file", F.explode(P.file_signals(F.col("file"), F.col("t"))).alias("signal")).distinct()


@query(with_(FACTS) + "SELECT service, CAST(count(*) FILTER (WHERE kind = 'exposure') AS BIGINT) AS exposures, CAST(count(*) FILTER (WHERE kind = 'dependency') AS BIGINT) AS dependencies, min(entity_id) AS first_trace FROM facts GROUP BY service")
def pr25_compact_services(spark, d):
    return B.facts(spark, d).groupBy("service").agg(F.count_if(F.col("kind") == "exposure").alias("exposures"), F.count_if(F.col("kind") == "dependency").alias("dependencies"), F.min("entity_id").alias("first_trace"))


@query("SELECT run_id, project_id FROM graph_runs WHERE project_id IN (SELECT project_id FROM refresh_jobs WHERE trigger_name = 'manual' AND deleted_at IS NULL)")
def pr26_visible_projects(spark, d):
    """Runs of the projects a caller may see: here those somebody has started a job of."""
    access = table(spark, d, "refresh_jobs").where("trigger_name = 'manual' and deleted_at is null").select("project_id").distinct()
    return table(spark, d, "graph_runs").join(access, "project_id", "left_semi").select("run_id", "project_id")


@query(with_(FACTS, "latest AS (SELECT project_id, max(finished_at) AS finished_at, arg_max(status, finished_at) AS status FROM graph_runs GROUP BY project_id)") + """
SELECT f.project_id, f.service, CASE WHEN l.project_id IS NULL THEN 'unknown' WHEN max(f.observed_at) > l.finished_at THEN 'stale' ELSE 'current' END AS freshness, coalesce(l.status, 'none') AS last_status
FROM facts f LEFT JOIN latest l USING (project_id) GROUP BY f.project_id, f.service, l.project_id, l.finished_at, l.status""")
def pr27_freshness(spark, d):
    runs = table(spark, d, "graph_runs").groupBy("project_id").agg(F.max("finished_at").alias("finished_at"), F.max_by("status", "finished_at").alias("status"))
    seen = B.facts(spark, d).groupBy("project_id", "service").agg(F.max("observed_at").alias("seen"))
    j = seen.join(runs, "project_id", "left")
    return j.select("project_id", "service", F.when(F.col("finished_at").isNull(), "unknown").when(F.col("seen") > F.col("finished_at"), "stale").otherwise("current").alias("freshness"), F.coalesce("status", F.lit("none")).alias("last_status"))


@query(with_(FACTS) + r"""SELECT entity_id, coalesce(nullif(trim(logical_name), ''), nullif(trim(instance), ''), name) AS target, coalesce(nullif(trim(operation_kind), ''), 'read/write') AS operations FROM facts WHERE type IN ('workflow_orchestration', 'cache_operation')""")
def pr28_name_ladders(spark, d):
    f = B.facts(spark, d).where("type in ('workflow_orchestration', 'cache_operation')")
    return f.select("entity_id", N.first_non_empty("logical_name", "instance", "name").alias("target"), F.coalesce(F.nullif(F.trim("operation_kind"), F.lit("")), F.lit("read/write")).alias("operations"))


@query(with_(LINKS) + r"""SELECT DISTINCT symbol, CASE WHEN regexp_matches(m, '^(find|get|read|load|list|fetch|query|search|count|exists|select)') THEN 'read'
  WHEN regexp_matches(m, '^(save|insert|update|delete|remove|write|create|upsert|persist|put|merge|archive|import|allocate|reserve|release|cancel|confirm|approve|restore|reprice|split|publish)') THEN 'write' ELSE 'unknown' END AS kind
FROM (SELECT s.to_symbol AS symbol, lower(regexp_extract(s.to_symbol, '([^.]+)$', 1)) AS m FROM (SELECT unnest(p.steps) AS s FROM (SELECT unnest(paths) AS p FROM links)) WHERE s.to_symbol IS NOT NULL)""")
def pr29_symbol_operations(spark, d):
    s = B.links(spark, d).select(F.explode("paths").alias("p")).select(F.explode("p.steps").alias("s")).select(F.col("s.to_symbol").alias("symbol")).where("symbol is not null").distinct()
    return s.select("symbol", P.method_kind(F.col("symbol")).alias("kind"))


@query(with_(FACTS) + "SELECT entity_id, type IN ('outbound_http', 'outbound_rpc', 'queue_publish', 'stream_consume') AS addresses_service FROM facts WHERE kind = 'dependency'")
def pr30_service_address(spark, d):
    return B.facts(spark, d).where("kind = 'dependency'").select("entity_id", F.col("type").isin(*P.ADDRESS_TYPES).alias("addresses_service"))


@query(with_(FACTS) + r"""SELECT entity_id, upper(coalesce(nullif(trim(d_method), ''), regexp_extract(name, '(?i)\b(GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)\s+\S+', 1))) AS method,
  coalesce(nullif(trim(d_path), ''), regexp_extract(name, '\s(/\S*)', 1)) AS path FROM facts WHERE type IN ('http_route', 'webhook', 'outbound_http')""")
def pr31_route_fields(spark, d):
    f = B.facts(spark, d).where("type in ('http_route', 'webhook', 'outbound_http')")
    return f.select("entity_id", F.upper(F.coalesce(F.nullif(F.trim("d_method"), F.lit("")), N.http_method("name"))).alias("method"), F.coalesce(F.nullif(F.trim("d_path"), F.lit("")), F.regexp_extract("name", r"\s(/\S*)", 1)).alias("path"))
