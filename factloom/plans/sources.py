"""Readers and derivations over the project's tables: markers, metrics, configuration, contracts, snapshots, catalog."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from factloom.functions import norm as N
from factloom.operators import derive as X
from factloom.plans import base as B
from factloom.plans.base import CLIENTS, FACTS, LINKS, ORACLE, QUERIES, query, with_  # noqa: F401
from factloom.sources import files as S
from factloom.sources import store
from factloom.sources.tables import table

_EXT = "lower(regexp_extract(file, '\\.([A-Za-z0-9]+)$', 1))"
_LANG = f"CASE {_EXT} " + " ".join(f"WHEN '{k}' THEN '{v[0]}'" for k, v in S.LANGUAGES.items()) + " END"
_WEIGHT = f"CASE {_EXT} " + " ".join(f"WHEN '{k}' THEN {v[1]}" for k, v in S.LANGUAGES.items()) + " END"


@query(with_(FACTS) + f"SELECT file, {_LANG} AS language, regexp_matches(file, '(^|/)(tests?|__tests__|testdata|fixtures?|mocks?|spec|examples?)(/|$)|(_test\\.|\\.test\\.|\\.spec\\.|Test\\.java$|Tests\\.java$)') AS test_like FROM (SELECT DISTINCT file FROM facts WHERE file IS NOT NULL)")
def s1_file_classes(spark, d):
    f = B.facts(spark, d).select("file").where("file is not null").distinct()
    return f.select("file", S.language("file").alias("language"), F.col("file").rlike(S.TEST_LIKE).alias("test_like"))


@query(r"SELECT doc_id, CAST(i - 1 AS INT) AS part, length(p) AS chars FROM (SELECT doc_id, generate_subscripts(l, 1) AS i, unnest(l) AS p FROM (SELECT doc_id, string_split(text, chr(10) || '---' || chr(10)) AS l FROM documents WHERE text IS NOT NULL))")
def s4_document_parts(spark, d):
    """Multi-document texts split at their separators."""
    parts = table(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n---\n")).alias("part", "p"))
    return parts.select("doc_id", "part", F.length("p").cast("bigint").alias("chars"))


@query(r"""SELECT CAST(id AS VARCHAR) AS doc, j->>'$.schema' AS schema, j->>'$.service.name' AS service, j->>'$.service.team' AS team FROM (SELECT DISTINCT ON (service_doc_id) service_doc_id AS id, TRY_CAST(body AS JSON) AS j FROM service_docs) WHERE json_type(j) = 'OBJECT' AND regexp_matches(j->>'$.schema', '\.service\.v1$')""")
def s5_document_headers(spark, d):
    s = table(spark, d, "service_docs").dropDuplicates(["service_doc_id"]).select(F.col("service_doc_id").cast("string").alias("doc"), F.try_parse_json("body").alias("j"))
    get = lambda p, n: F.expr(f"try_variant_get(j, '{p}', 'string')").alias(n)
    return s.select("doc", get("$.schema", "schema"), get("$.service.name", "service"), get("$.service.team", "team")).where(F.col("schema").rlike(store.SCHEMA_PATTERN))


@query(with_(FACTS) + "SELECT kind, type, count(*) AS items, count(DISTINCT service) AS services FROM facts GROUP BY kind, type")
def s6_run_contents(spark, d):
    return B.facts(spark, d).groupBy("kind", "type").agg(F.count("*").alias("items"), F.countDistinct("service").alias("services"))


@query("SELECT project_id, arg_max(run_id, {'f': finished_at, 'r': run_id}) AS run_id, CAST(arg_max(edge_count, {'f': finished_at, 'r': run_id}) AS INT) AS edge_count FROM graph_runs WHERE status IN ('succeeded', 'completed') GROUP BY project_id")
def s7_run_discovery(spark, d):
    return store.latest_runs(table(spark, d, "graph_runs")).select("project_id", "run_id", "edge_count")


@query(with_(FACTS) + "SELECT service, file, regexp_extract(file, '([^/]+)$', 1) AS base, regexp_extract(file, '^([^/]+)/', 1) AS area FROM (SELECT DISTINCT service, file FROM facts WHERE file IS NOT NULL AND regexp_matches(file, '\\.(tf|json|yml|toml|properties)$'))")
def s10_marker_files(spark, d):
    f = B.facts(spark, d).where(F.col("file").rlike(r"\.(tf|json|yml|toml|properties)$")).select("service", "file").distinct()
    return f.select("service", "file", F.regexp_extract("file", r"([^/]+)$", 1).alias("base"), F.regexp_extract("file", r"^([^/]+)/", 1).alias("area"))


#: Languages of fenced blocks and the endings of files they would be; fixed values.
FENCES = {"go": "go", "java": "java", "kotlin": "kt", "python": "py", "py": "py", "ts": "ts", "typescript": "ts", "js": "js", "javascript": "js", "ruby": "rb", "rust": "rs", "csharp": "cs", "php": "php", "sql": "sql", "yaml": "yaml", "yml": "yaml", "json": "json", "toml": "toml", "hcl": "tf", "terraform": "tf", "sh": "sh", "bash": "sh"}


def code_files(spark, d):
    """(doc_id, path, language, format, bytes, text) of the code blocks inside documents, as files of their languages."""
    pattern = F.lit(r"(?s)```(\w+)\n(.*?)```")
    t = table(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(F.arrays_zip(F.regexp_extract_all("text", pattern, F.lit(1)).alias("fence"), F.regexp_extract_all("text", pattern, F.lit(2)).alias("text"))).alias("block", "x"))
    ext = F.create_map(*[F.lit(x) for kv in FENCES.items() for x in kv])[F.lower("x.fence")]
    f = t.select("doc_id", F.concat(F.lit("docs/"), "doc_id", F.lit("/"), "block", F.lit("."), ext).alias("path"), F.col("x.text").alias("text")).where("path is not null").distinct()
    return f.select("doc_id", "path", S.language("path").alias("language"), S._map(S.CONFIG_FORMATS)[S.extension("path")].alias("format"), F.octet_length("text").cast("long").alias("bytes"), "text")


_FENCED = "bl AS (SELECT DISTINCT doc_id, i, f, b FROM (SELECT doc_id, generate_subscripts(fs, 1) AS i, unnest(fs) AS f, unnest(bs) AS b FROM (SELECT doc_id, regexp_extract_all(text, '(?s)```(\\w+)\\n(.*?)```', 1) AS fs, regexp_extract_all(text, '(?s)```(\\w+)\\n(.*?)```', 2) AS bs FROM documents WHERE text IS NOT NULL)))"
_FLANG = "CASE lower(f) " + " ".join(f"WHEN '{k}' THEN '{S.LANGUAGES[v][0]}'" for k, v in FENCES.items()) + " END"
_FWEIGHT = "CASE lower(f) " + " ".join(f"WHEN '{k}' THEN {S.LANGUAGES[v][1]}" for k, v in FENCES.items()) + " END"


@query(with_(_FENCED) + f"SELECT language, count(*) AS files, CAST(sum(n) AS BIGINT) AS loc, CAST(round(sum(n * w), 3) AS DOUBLE) AS weighted FROM (SELECT {_FLANG} AS language, {_FWEIGHT} AS w, len(list_filter(string_split(b, chr(10)), lambda x: trim(x) <> '')) AS n FROM bl) WHERE language IS NOT NULL GROUP BY language")
def s11_language_metrics(spark, d):
    """Files, lines that aren't blank and weighted lines of the code inside documents, by language."""
    return S.metrics(code_files(spark, d))


@query()
def s3_config_entries(spark, d):
    """Entries of the configuration blocks inside documents, in the format of each."""
    return S.config_entries(code_files(spark, d).where("format is not null").select("doc_id", F.regexp_extract("path", r"/(\d+)\.\w+$", 1).cast("int").alias("block"), "format", "text"), ("doc_id", "block"))


@query(with_(_FENCED) + r"""SELECT DISTINCT doc_id, regexp_extract(f, '^func \(\w+ \*?(\w+)\) (\w+)\(', 1) || '.' || regexp_extract(f, '^func \(\w+ \*?(\w+)\) (\w+)\(', 2) AS symbol, c AS calls FROM (SELECT doc_id, f, unnest(regexp_extract_all(regexp_extract(f, '\{([^{}]*)\}', 1), '\b((?:\w+\.)+\w+)\s*\(', 1)) AS c FROM (SELECT doc_id, unnest(regexp_extract_all(b, '(?m)^func \(\w+ \*?\w+\) \w+\([^\n]*\{[^{}]*\}')) AS f FROM bl WHERE lower(f) = 'go'))""")
def s2_source_symbols(spark, d):
    """Functions and what they call, from the whole code blocks inside documents, in every language the parser reads."""
    from factloom.sources import code

    rows = code.parsed(code_files(spark, d))
    return rows.where("row_kind = 'call' and name <> ''").select(F.regexp_extract("path", r"^docs/(-?\d+)/", 1).cast("bigint").alias("doc_id"), F.col("name").alias("symbol"), F.col("target").alias("calls")).distinct()


@query(with_(FACTS) + "SELECT file, start_line AS line, min(entity_id) AS definition, count(*) AS n FROM facts WHERE file IS NOT NULL GROUP BY ALL")
def s12_definitions(spark, d):
    """The definition at each position: the index that position lookups use."""
    return B.facts(spark, d).where("file is not null").groupBy("file", F.col("start_line").alias("line")).agg(F.min("entity_id").alias("definition"), F.count("*").alias("n"))


@query("""WITH l AS (SELECT project_id, arg_max(run_id, {'f': finished_at, 'r': run_id}) AS run_id FROM graph_runs WHERE status IN ('succeeded', 'completed') GROUP BY project_id) SELECT c.project_id, c.run_id, service, endpoint_id, count(*) AS fields FROM contract_fields c JOIN l USING (project_id, run_id) GROUP BY ALL""")
def s16_latest_snapshot(spark, d):
    s = store.load_snapshot(table(spark, d, "contract_fields"), table(spark, d, "graph_runs"))
    return s.groupBy("project_id", "run_id", "service", "endpoint_id").agg(F.count("*").alias("fields"))


@query("SELECT CAST(ts AS DATE)::VARCHAR AS day, event_type, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM events GROUP BY ALL")
def s17_event_log(spark, d):
    return table(spark, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


_JOB = ["job_id", "project_id", "trigger_name", "status", "payload_digest", "not_before", "cancel_requested", "max_attempts"]
_JOBS_SQL = ", ".join(_JOB)


@query(f"""WITH o AS (SELECT {_JOBS_SQL} FROM refresh_jobs QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY ingested_at) = 1), n AS (SELECT {_JOBS_SQL} FROM refresh_jobs QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY ingested_at DESC) = 1),
l AS (SELECT project_id, count(*) AS lost FROM (SELECT * FROM o EXCEPT ALL SELECT * FROM n) GROUP BY project_id), x AS (SELECT project_id, count(*) AS unknown FROM (SELECT * FROM n EXCEPT ALL SELECT * FROM o) GROUP BY project_id), c AS (SELECT project_id, count(*) AS stored, count(DISTINCT job_id) AS jobs FROM refresh_jobs GROUP BY project_id)
SELECT project_id, stored, jobs, CAST(coalesce(lost, 0) AS BIGINT) AS lost, CAST(coalesce(unknown, 0) AS BIGINT) AS unknown FROM c LEFT JOIN l USING (project_id) LEFT JOIN x USING (project_id)""")
def s18_queue_verify(spark, d):
    """The queue as first delivered against the queue as last delivered: rows that either copy has alone, per project."""
    j = table(spark, d, "refresh_jobs")
    copy = lambda order: j.withColumn("n", F.row_number().over(Window.partitionBy("job_id").orderBy(order))).where("n = 1").select(_JOB)
    return store.verify_copy(j, copy(F.col("ingested_at")), copy(F.desc("ingested_at")))


@query(with_(FACTS) + """, c AS (SELECT service || '|' || type AS key, CASE WHEN bool_or(lower(trim(ref_source)) = 'manual') THEN 'manual' ELSE 'automation' END AS owner, min(nullif(trim(platform), '')) AS platform, min(nullif(trim(summary), '')) AS summary FROM facts WHERE observed_at < TIMESTAMP '2025-06-01' GROUP BY ALL),
n AS (SELECT service || '|' || type AS key, max(nullif(trim(platform), '')) AS platform, max(nullif(trim(summary), '')) AS summary FROM facts WHERE observed_at >= TIMESTAMP '2025-06-01' GROUP BY ALL)
SELECT key, coalesce(c.owner, 'automation') AS owner, CASE WHEN c.owner = 'manual' THEN coalesce(c.platform, n.platform) ELSE coalesce(n.platform, c.platform) END AS platform, CASE WHEN c.owner = 'manual' THEN coalesce(c.summary, n.summary) ELSE coalesce(n.summary, c.summary) END AS summary,
  CASE WHEN c.key IS NULL THEN 'added' WHEN n.key IS NULL THEN 'kept' WHEN c.owner = 'manual' THEN 'manual' ELSE 'updated' END AS outcome FROM c FULL JOIN n USING (key)""")
def s20_catalog_import(spark, d):
    f = B.facts(spark, d).withColumn("key", F.concat_ws("|", "service", "type"))
    day = F.lit("2025-06-01").cast("timestamp")
    v = lambda fn, c: fn(F.nullif(F.trim(c), F.lit(""))).alias(c)
    old = f.where(F.col("observed_at") < day).groupBy("key").agg(F.when(F.coalesce(F.bool_or(N.lower("ref_source") == "manual"), F.lit(False)), "manual").otherwise("automation").alias("owner"), v(F.min, "platform"), v(F.min, "summary"))
    new = f.where(F.col("observed_at") >= day).groupBy("key").agg(v(F.max, "platform"), v(F.max, "summary"))
    return store.catalog_import(old, new, "key", ["platform", "summary"])


@query(with_(CLIENTS) + "SELECT service, count(DISTINCT config_source) AS sources, string_agg(DISTINCT split_part(config_source, ':', 1), ',' ORDER BY split_part(config_source, ':', 1)) AS files FROM clients WHERE config_source IS NOT NULL GROUP BY service")
def s23_layered_config(spark, d):
    c = B.clients(spark, d).where("config_source is not null")
    return c.groupBy("service").agg(F.countDistinct("config_source").alias("sources"), F.array_join(F.array_sort(F.collect_set(F.split_part("config_source", F.lit(":"), F.lit(1)))), ",").alias("files"))


@query(with_(FACTS) + ", o AS (SELECT service, max(tag) AS tag FROM facts GROUP BY service), i AS (SELECT lower(replace(split_part(dns_name, '.', 1), '_', '-')) AS service, max(owner_team) AS team FROM infra_inventory WHERE dns_name IS NOT NULL GROUP BY 1) SELECT service, coalesce(o.tag, i.team, 'default') AS team, CASE WHEN o.tag IS NOT NULL THEN 'document' WHEN i.team IS NOT NULL THEN 'inventory' ELSE 'none' END AS source FROM o LEFT JOIN i USING (service)")
def s24_service_metadata(spark, d):
    """Team of a service: its own documents first, then the inventory, then the default."""
    o = B.facts(spark, d).groupBy("service").agg(F.max("tag").alias("tag"))
    i = table(spark, d, "infra_inventory").where("dns_name is not null").groupBy(F.lower(F.translate(F.split_part("dns_name", F.lit("."), F.lit(1)), "_", "-")).alias("service")).agg(F.max("owner_team").alias("team_i"))
    return o.join(i, "service", "left").select("service", F.coalesce("tag", "team_i", F.lit("default")).alias("team"), F.when(F.col("tag").isNotNull(), "document").when(F.col("team_i").isNotNull(), "inventory").otherwise("none").alias("source"))


_SN = "sn AS (SELECT DISTINCT entity_id, e.snippet AS t FROM (SELECT entity_id, unnest(evidence) AS e FROM entities) WHERE trim(e.snippet) <> '')"


def _sites(spark, d):
    return table(spark, d, "entities").select("entity_id", F.explode("evidence.snippet").alias("snippet")).where("trim(snippet) <> ''").distinct()


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _hits_sql(types: tuple[str, ...]) -> str:
    """All hits of the detectors of some fact types over sn, as SQL."""
    part = lambda x, g: f"regexp_extract_all(t, {_quoted(x.pattern)}, {g})"
    rows = [
        f"SELECT entity_id, '{x.fact_type}' AS fact_type, '{x.framework}' AS framework, '{x.language}' AS language, unnest({part(x, x.name)}) AS name, " + (f"unnest({part(x, x.detail)})" if x.detail else "''") + " AS detail FROM sn"
        for x in X.DETECTORS if x.fact_type in types
    ]
    return f"{_SN}, hits AS (SELECT DISTINCT entity_id, fact_type, framework, language, coalesce(name, '') AS name, lower(coalesce(detail, '')) AS detail FROM ({' UNION ALL '.join(rows)}))"


def _derived(name: str, doc: str, *types: str) -> None:
    def run(spark, d):
        return X.call_facts(_sites(spark, d), ["entity_id"], types=types).drop("language").distinct()

    run.__name__, run.__doc__ = name, doc
    query(with_(_hits_sql(types)) + "SELECT DISTINCT entity_id, fact_type, framework, name, detail FROM hits")(run)


_derived("x1_http_routes", "Routes that framework bindings declare.", "http_route", "cli_command", "scheduled_job")
_derived("x2_sql_operations", "Operations on stores: statements, repositories, mappers.", "db_operation")
_derived("x3_queue_publish", "What is sent to and taken from queues and streams.", "queue_publish", "queue_consumer")
_derived("x4_outbound_http", "Calls to others over HTTP.", "outbound_http")
_derived("x5_outbound_rpc", "Calls to others by procedure.", "outbound_rpc")
_derived("x6_cache_operations", "Operations on caches and object stores.", "cache_operation", "object_storage")
_derived("x7_command_exec", "Commands and workflows that are run.", "command_exec", "workflow_call")

_CLIENT_TYPES = ("outbound_http", "outbound_rpc", "queue_publish", "cache_operation", "object_storage")
_ALL_TYPES = tuple(dict.fromkeys(x.fact_type for x in X.DETECTORS))


@query(with_(_hits_sql(_CLIENT_TYPES), FACTS) + "SELECT f.service, h.fact_type AS kind, h.framework, h.name AS target, count(DISTINCT h.entity_id) AS sites FROM hits h JOIN facts f USING (entity_id) WHERE h.name <> '' GROUP BY ALL")
def x11_client_detection(spark, d):
    """The clients in each service's source: what they are built with and what they point to."""
    hits = X.call_facts(_sites(spark, d), ["entity_id"], types=_CLIENT_TYPES).where("name <> ''")
    return hits.join(B.facts(spark, d).select("entity_id", "service"), "entity_id").groupBy("service", F.col("fact_type").alias("kind"), "framework", F.col("name").alias("target")).agg(F.countDistinct("entity_id").alias("sites"))


@query(with_(_hits_sql(_ALL_TYPES)) + "SELECT language, framework, fact_type, count(DISTINCT entity_id) AS sites, count(*) AS hits FROM hits GROUP BY ALL")
def x12_framework_detection(spark, d):
    """Which frameworks the source shows, by language and kind of fact."""
    h = X.call_facts(_sites(spark, d), ["entity_id"]).distinct()
    return h.groupBy("language", "framework", "fact_type").agg(F.countDistinct("entity_id").alias("sites"), F.count("*").alias("hits"))


@query(with_(FACTS, CLIENTS) + "SELECT f.entity_id, coalesce(nullif(trim(f.host), ''), c.host) AS host FROM facts f JOIN (SELECT project_id, service, max(host) AS host FROM clients WHERE host <> '' GROUP BY ALL HAVING count(DISTINCT host) = 1) c ON c.project_id = f.project_id AND c.service = f.service WHERE f.kind = 'dependency'")
def x8_instance_identity(spark, d):
    """Dependencies without a host take their service's only client host."""
    c = B.clients(spark, d).where("host <> ''").groupBy("project_id", "service").agg(F.max("host").alias("only_host"), F.countDistinct("host").alias("n")).where("n = 1")
    return B.facts(spark, d).where("kind = 'dependency'").join(c, ["project_id", "service"]).select("entity_id", F.coalesce(F.nullif(F.trim("host"), F.lit("")), F.col("only_host")).alias("host"))


@query(with_(CLIENTS) + "SELECT service, min(ref_kind) AS platform FROM clients WHERE kind = 'db' AND ref_kind IS NOT NULL GROUP BY service HAVING count(DISTINCT ref_kind) = 1")
def x9_platform_inference(spark, d):
    return B.clients(spark, d).where("kind = 'db' and ref_kind is not null").groupBy("service").agg(F.min("ref_kind").alias("platform"), F.countDistinct("ref_kind").alias("n")).where("n = 1").drop("n")


@query(with_(FACTS) + r"SELECT DISTINCT entity_id, unnest(regexp_extract_all(coalesce(d_path, name), '\{([^{}/]*)\}', 1)) AS parameter FROM facts WHERE type IN ('http_route', 'webhook')")
def x10_route_parameters(spark, d):
    f = B.facts(spark, d).where("type in ('http_route', 'webhook')")
    return f.select("entity_id", F.explode(F.regexp_extract_all(F.coalesce("d_path", "name"), F.lit(r"\{([^{}/]*)\}"), F.lit(1))).alias("parameter")).distinct()


_PLACE = "CASE lower(p) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in X.PLACES.items()) + " END"


@query(with_(_SN) + f"""SELECT DISTINCT entity_id, 'auth' AS what, '' AS place, lower(regexp_replace(x, '[@\\[]|\\(.*$', '', 'g')) AS name FROM (SELECT entity_id, unnest(regexp_extract_all(t, {_quoted(X.AUTH)}, 0)) AS x FROM sn)
UNION SELECT entity_id, 'parameter', {_PLACE}, n FROM (SELECT entity_id, unnest(regexp_extract_all(t, {_quoted(X.PARAMETERS)}, 1)) AS p, unnest(regexp_extract_all(t, {_quoted(X.PARAMETERS)}, 2)) AS n FROM sn)""")
def x10_enrichments(spark, d):
    """What handlers ask of their callers: rights, and the parameters they bind."""
    return X.enrichments(_sites(spark, d), ["entity_id"]).distinct()


@query(with_(_hits_sql(("scheduled_job",))) + r"SELECT DISTINCT entity_id, name AS expression, regexp_matches(name, '^\s*(?:[\d*/,\-?LW#]+\s+){4,5}[\d*/,\-?LW#A-Z]+\s*$') AS is_cron, len(regexp_split_to_array(trim(name), '\s+')) AS fields FROM hits")
def fd_cron_expressions(spark, d):
    """Schedules found in source, and whether they are cron expressions."""
    h = X.call_facts(_sites(spark, d), ["entity_id"], types=("scheduled_job",))
    return h.select("entity_id", F.col("name").alias("expression"), X.looks_like_cron(F.col("name")).alias("is_cron"), F.size(F.split(F.trim("name"), r"\s+")).cast("bigint").alias("fields")).distinct()


@query(with_(FACTS) + "SELECT entity_id, CASE WHEN s IN ('deterministic', 'ast', 'config', 'runtime') THEN 'deterministic' WHEN s = 'manual' THEN 'manual' WHEN s = '' THEN 'unknown' ELSE 'heuristic' END AS provenance FROM (SELECT entity_id, lower(trim(coalesce(ref_source, ''))) AS s FROM facts)")
def x13_provenance(spark, d):
    s = N.lower("ref_source")
    return B.facts(spark, d).select("entity_id", F.when(s.isin("deterministic", "ast", "config", "runtime"), "deterministic").when(s == "manual", "manual").when(s == "", "unknown").otherwise("heuristic").alias("provenance"))
