"""Filters and projections over facts: gates, classifiers, target choices."""

from __future__ import annotations

import re
from functools import reduce as fold

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import norm as N

MIN_CONFIDENCE = 0.70
#: Details that a fact of a type must have; fixed values.
REQUIRED = {"http_route": ("method", "path"), "webhook": ("method", "path"), "outbound_http": ("method", "path"), "db_operation": ("table",)}
ADDRESS_TYPES = ("outbound_http", "outbound_rpc", "queue_publish", "stream_consume")
TEST_LIKE = r"(^|/)(tests?|__tests__|testdata|fixtures?|mocks?|spec|examples?)(/|$)|(_test\.|\.test\.|\.spec\.|Test\.java$|Tests\.java$)"
CONFIG_LIKE = r"\.(ya?ml|json|toml|properties|env|tf|ini)$"


#: Other names of fact types by kind; fixed values.
TYPE_ALIASES = {
    "exposure": {
        "http_endpoint": "http_route", "api_route": "http_route", "rest_endpoint": "http_route", "sqs_listener": "queue_consumer", "sqs_consumer": "queue_consumer", "message_listener": "queue_consumer", "event_listener": "queue_consumer",
        "cron_job": "scheduled_job", "scheduler": "scheduled_job", "lambda_handler": "cli_command",
    },
    "dependency": {
        "outbound_http_service": "outbound_http", "external_service": "outbound_http", "http_client": "outbound_http", "api_client": "outbound_http", "sqs_publish": "queue_publish", "queue_send": "queue_publish", "topic_publish": "queue_publish",
        "stream_consumer": "stream_consume", "database": "db_operation", "sql_query": "db_operation", "repository_operation": "db_operation", "shell_command": "command_exec", "process_exec": "command_exec",
    },
}
#: Names that say that nothing was found; fixed values.
NO_RESULT_NAMES = ("", "none", "null", "nil", "na", "placeholder", "dummy", "noresult", "noresults", "notfound")
NO_RESULT_PARTS = ("none", "placeholder", "dummy")
NO_RESULT_BEGINNINGS, NO_RESULT_WORDS = ("no ", "nothing "), (" found", " confirmed", " detected", " exist")


def type_name(kind: Column, type_: Column) -> Column:
    """The type in lower case with underscores, and by its usual name."""
    t = F.regexp_replace(F.lower(F.trim(type_)), "[ -]", "_")
    pairs = [F.lit(x) for k, m in TYPE_ALIASES.items() for a, b in m.items() for x in (f"{k}/{a}", b)]
    return F.coalesce(F.create_map(*pairs)[F.concat(F.coalesce(kind, F.lit("")), F.lit("/"), t)], t)


def says_nothing(name: Column, type_: Column, summary: Column) -> Column:
    """Whether a fact is filler that only says that nothing was found."""
    compact = F.regexp_replace(F.lower(F.trim(F.coalesce(name, F.lit("")))), r"[ \-_./]", "")
    s = F.lower(F.trim(F.coalesce(summary, F.lit(""))))
    any_ = lambda f, c, words: fold(lambda a, b: a | b, (f(c, F.lit(w)) for w in words))
    negative = any_(F.startswith, s, NO_RESULT_BEGINNINGS) & any_(F.contains, s, NO_RESULT_WORDS)
    of_type = compact == F.regexp_replace(F.lower(F.coalesce(type_, F.lit(""))), "_", "")
    return compact.isin(*NO_RESULT_NAMES) | (F.startswith(compact, F.lit("no")) & F.endswith(compact, F.lit("found"))) | (negative & (of_type | compact.isin("noop", "nooperation") | any_(F.contains, compact, NO_RESULT_PARTS)))


def gate(df: DataFrame, least: float = MIN_CONFIDENCE) -> DataFrame:
    """With `reason`: why a candidate is no entity; null if it is one."""
    return df.withColumn(
        "reason",
        F.when(N.text("name") == "", "missing_name").when(N.text("type") == "", "missing_type").when(F.col("confidence").isNull() | F.isnan("confidence"), "missing_confidence")
        .when(F.col("confidence") < least, "low_confidence").when(F.col("n_locations") == 0, "missing_location"))


def glob_regex(pattern: str) -> str:
    """An anchored regular expression for a glob with ** (any folders), * (inside a folder), ? and classes like [a-m]."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif pattern[i] == "[" and pattern.find("]", i + 2) > 0:
            end = pattern.find("]", i + 2)
            out, i = out + "[" + pattern[i + 1 : end].replace("\\", "\\\\") + "]", end + 1
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(pattern[i], re.escape(pattern[i]))
            i += 1
    return f"^{out}$"


def is_junk_resource(resource: Column) -> Column:
    """Sequences and the entity manager handle; a schema qualifier doesn't matter."""
    base = F.regexp_extract(F.lower(F.trim(resource)), r"([^.]*)$", 1)
    return (F.lower(F.trim(resource)) == "entity_manager") | base.rlike("_(seq|sequence)$")


def drop_junk(df: DataFrame) -> DataFrame:
    """Without datastore facts on artifacts that are no tables."""
    r = F.coalesce(F.nullif(F.trim("d_table"), F.lit("")), F.col("name"))
    return df.where(~(F.col("type").isin("db_operation", "cache_operation") & F.coalesce(is_junk_resource(r), F.lit(False))))


def drop_transport_duplicates(df: DataFrame) -> DataFrame:
    """Without HTTP facts that only are the transport of a queue or query service the same service is known to use."""
    p, n, o = (F.lower(F.coalesce(c, F.lit(""))) for c in ("platform", "name", "operation"))
    uses = df.groupBy("project_id", "service").agg(
        F.coalesce(F.bool_or((F.col("type") == "queue_publish") & (p == "sqs")), F.lit(False)).alias("sqs"), F.coalesce(F.bool_or((F.col("type") == "db_operation") & ((p == "athena") | F.contains(n, F.lit("athena")))), F.lit(False)).alias("athena"))
    about = {"sqs": (p == "sqs") | F.contains(n, F.lit("sqs")) | F.contains(o, F.lit("sendmessage")), "athena": (p == "athena") | F.contains(n, F.lit("athena")) | F.contains(o, F.lit("athena"))}
    transport = (F.col("type") == "outbound_http") & ((F.col("sqs") & about["sqs"]) | (F.col("athena") & about["athena"]))
    return df.join(uses, ["project_id", "service"]).where(~F.coalesce(transport, F.lit(False))).select(df.columns)


def collapse_job_entrypoints(df: DataFrame) -> DataFrame:
    """Without command line entry points in a file that declares a scheduled job of the same service."""
    jobs = df.where("type = 'scheduled_job' and coalesce(file, '') <> ''").select("service", "file").distinct().withColumn("command", F.lit("cli_command"))
    return df.join(jobs.withColumnRenamed("command", "type"), ["service", "file", "type"], "left_anti").select(df.columns)


def data_name(name: Column, table: Column, kind: Column) -> Column:
    """Names that are symbols (Class.method) as `operation resource`."""
    op, res = N.operation(kind), N.lower(table)
    symbol = name.rlike(r"^[^ ]+\.[^ ]+$")
    return F.when(symbol & (res != "") & (op != "") & (res != F.lower(name)), F.concat_ws(" ", op, res)).otherwise(name)


#: What a changed file is about, the first that fits: parts of its path, endings, whole file names. Fixed values.
CHANGE_CATEGORIES = (
    ("tests", ("/test/", "/tests/", "_test.", ".spec.", ".test.", "__tests__"), (), ()),
    ("documentation", ("/docs/",), (".md", ".rst"), ()),
    ("data", ("migration", "schema.sql", "liquibase", "flyway", "prisma/schema", "db/schema"), (), ()),
    ("api", ("openapi", "swagger", ".proto", "graphql", "/routes/", "/controller", "/api/"), (), ()),
    ("security", ("auth", "security", "permission", "policy", "iam", "rbac", "oauth", "secret", "credential", "certificate", "tls"), (), ()),
    ("infrastructure", ("terraform", "helm/", "charts/", "k8s/", "kubernetes", "dockerfile", "docker-compose", ".github/workflows"), (".tf",), ()),
    ("dependencies", (), (), ("go.mod", "go.sum", "package.json", "package-lock.json", "pnpm-lock.yaml", "yarn.lock", "pom.xml", "build.gradle", "requirements.txt", "poetry.lock", "cargo.toml", "cargo.lock")),
    ("configuration", (), (".yaml", ".yml", ".json", ".toml", ".ini", ".conf", ".properties"), (".env*",)),
)
OTHER_CATEGORY = "code"
#: Risk of a change by category; fixed values.
CHANGE_RISK = {"api": 20, "data": 25, "security": 25, "infrastructure": 18, "dependencies": 15, "configuration": 10, "tests": 0, "documentation": 0, "code": 8}
#: Signals by category and by what a patch says, with their severity. Fixed values.
CATEGORY_SIGNALS = {"api": "contract_change", "data": "data_migration", "security": "security_boundary", "infrastructure": "deployment_change", "dependencies": "dependency_change"}
PATCH_SIGNALS = {"public_surface_removal": ("-func ", "-public ", "-export ", "-interface "), "destructive_schema": ("drop table", "drop column", "alter table")}
SEVERITY = {"contract_change": "high", "data_migration": "high", "destructive_schema": "high", "security_boundary": "high", "public_surface_removal": "high", "deployment_change": "medium", "dependency_change": "medium"}


def category_patterns() -> list[tuple[str, str]]:
    """(category, expression over a lower-case path), in order; the same for Spark and for SQL."""
    name = lambda n: "(^|/)" + re.escape(n).replace(r"\*", "[^/]*") + "$"
    return [(c, "|".join([*map(re.escape, parts), *(re.escape(e) + "$" for e in ends), *map(name, names)])) for c, parts, ends, names in CHANGE_CATEGORIES]


def changed_file_kind(path: Column) -> Column:
    """What a changed file is about; the first that fits."""
    p = F.lower(path)
    return N.ladder(p, [(p.rlike(rx), c) for c, rx in category_patterns()], F.lit(OTHER_CATEGORY))


def patch_says(patch: Column, signal: str) -> Column:
    return F.lower(F.coalesce(patch, F.lit(""))).rlike("|".join(map(re.escape, PATCH_SIGNALS[signal])))


def file_signals(path: Column, patch: Column) -> Column:
    """Signals of a change from its file's category and its patch, as an array."""
    k = changed_file_kind(path)
    return F.array_compact(F.array(*(F.when(k == c, s) for c, s in CATEGORY_SIGNALS.items()), *(F.when(patch_says(patch, s), s) for s in PATCH_SIGNALS)))


#: Details that name a target, in order, and words that name none. Fixed values.
TARGET_DETAILS = (
    "url", "base_url", "target_url", "default_url", "production_url", "host", "target_host", "target_service", "service", "queue", "queue_name", "destination", "topic", "database_name", "database", "table_or_entity", "table", "entity", "instance",
)
NO_TARGETS = ("", "unknown", "http", "rpc", "database", "cache", "queue", "kafka", "sqs", "sns", "postgres", "postgresql", "mysql", "redis", "dynamodb", "mongodb")
TARGET_TAGS = ("-api", "-service", ".")
TARGET_WORDS = ("://", ".internal", ".global")


def target(entities: DataFrame) -> Column:
    """What a dependency points to: its instance, a detail, a tag, a word of its evidence, or its name; over raw entities."""
    useful = lambda c: F.when(~F.lower(F.trim(c)).isin(*NO_TARGETS), F.trim(c))
    j = F.try_parse_json("details")
    detail = lambda k: F.when(F.schema_of_variant(F.try_variant_get(j, f"$.{k}", "variant")) == "STRING", F.try_variant_get(j, f"$.{k}", "string"))
    has = lambda x, parts: x.rlike("|".join(map(re.escape, parts)))
    tag = F.try_element_at(F.filter("tags", lambda t: has(t, TARGET_TAGS)), F.lit(1))
    words = F.flatten(F.transform(F.coalesce("evidence.snippet", F.array().cast("array<string>")), lambda t: F.split(F.coalesce(t, F.lit("")), r"\s+")))
    word = F.try_element_at(F.filter(F.transform(words, lambda w: F.btrim(w, F.lit("\"'(){},;`"))), lambda w: has(w, TARGET_WORDS)), F.lit(1))
    return F.coalesce(useful(F.col("instance")), *(useful(detail(k)) for k in TARGET_DETAILS), tag, word, F.trim("name"))


def method_kind(symbol: Column) -> Column:
    """read, write or unknown of a repository method by its leading verb; deletes count as writes here."""
    m = F.lower(F.regexp_extract(symbol, r"([^.]+)$", 1))
    return F.when(m.rlike("^(find|get|read|load|list|fetch|query|search|count|exists|select)"), "read").when(m.rlike("^(save|insert|update|delete|remove|write|create|upsert|persist|put|merge|archive|import|allocate|reserve|release|cancel|confirm|approve|restore|reprice|split|publish)"), "write").otherwise("unknown")


def grouping(df: DataFrame) -> DataFrame:
    """(platform, instance, operation, operation_kind) by type."""
    t = F.col("type")
    op = (
        F.when(t.isin("http_route", "webhook", "outbound_http"), F.concat_ws(" ", F.upper(N.text("d_method")), N.text("d_path")))
        .when(t.isin("db_operation", "cache_operation"), F.concat_ws(" ", N.operation("operation_kind"), N.lower("d_table"))).when(t.isin("queue_publish", "queue_consumer", "stream_consume"), F.regexp_extract("name", r"\s(.*)$", 1)).otherwise(F.col("name"))
    )
    kind = (
        F.when(t.isin("db_operation", "cache_operation"), N.operation("operation_kind")).when(t == "queue_publish", "publish").when(t.isin("queue_consumer", "stream_consume"), "consume")
        .when(t.isin("http_route", "webhook", "rpc_endpoint"), "serve").when(t.rlike("^outbound"), "call").otherwise("run")
    )
    return df.select("entity_id", N.platform_class(N.first_known("platform", "ref_kind")).alias("platform"), N.first_non_empty("instance", "logical_name", "host").alias("instance"), F.trim(op).alias("operation"), kind.alias("operation_kind"))
