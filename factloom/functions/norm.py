"""Normalizers of names, routes, queues, kinds and operations as Catalyst expressions; null and blank mean absent."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists that decide results.
GENERIC_QUEUES = ("sqs", "sns", "kafka", "queue", "queues", "topic", "topics", "queueurl", "queuename", "queueurls", "requesturl", "responseurl", "sqsevent", "sqsmessage", "sqsmessagebody", "message", "messages", "event", "events", "stream", "input", "output", "source", "destination")
HTTP_METHODS = ("GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS")
UNCOUNTABLE = ("series", "species", "news", "data", "media", "metadata", "schema", "status", "alias", "analysis", "diagnosis", "basis", "index")
GENERIC_PLATFORMS = ("database", "db", "sql", "rdbms", "jdbc", "relational", "unknown")
PLATFORM_CLASSES = (
    ("postgres", "postgres"), ("mysql", "mysql"), ("mariadb", "mysql"), ("dynamo", "dynamodb"), ("mongo", "mongodb"), ("elastic", "elasticsearch"),
    ("opensearch", "elasticsearch"), ("redis", "redis"), ("memcache", "memcached"), ("cassandra", "cassandra"), ("athena", "athena"),
    ("snowflake", "snowflake"), ("bigquery", "bigquery"),
)
READ_VERBS = ("read", "select", "find", "get", "list", "query", "search", "exists", "count", "scan", "load", "fetch")
DELETE_VERBS = ("delete", "remove")
WRITE_VERBS = ("write", "insert", "update", "save", "upsert", "put", "merge", "persist", "store")
QUEUE_SUFFIXES = r"[-_.](consumer|listener)$"
CLUSTER_SUFFIXES = r"(\.svc\.cluster\.local|\.cluster\.local|\.corp\.example)$"
WRITE_WORDS = ("insert", "create", "write", "put", "store", "update", "delete", "upsert", "evict", "publish")
READ_WORDS = ("read", "select", "query", "scan", "get", "find", "load")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text(c: Column | str) -> Column:
    """Trimmed text, '' where absent."""
    return F.trim(F.coalesce(col(c).cast("string"), F.lit("")))


def lower(c: Column | str) -> Column:
    return F.lower(text(c))


def first_non_empty(*cs: Column | str) -> Column:
    """The first value that isn't blank, trimmed; '' if none."""
    return F.coalesce(*(F.nullif(text(c), F.lit("")) for c in cs), F.lit(""))


def first_known(*cs: Column | str) -> Column:
    """As first_non_empty, but `unknown` counts as absent."""
    return F.coalesce(*(F.when(~F.lower(text(c)).isin("", "unknown"), text(c)) for c in cs), F.lit(""))


def ladder(value: Column, steps: list[tuple[Column, str | Column]], other: Column) -> Column:
    """The result of the first condition that holds."""
    out = None
    for cond, result in steps:
        result = F.lit(result) if isinstance(result, str) else result
        out = F.when(cond, result) if out is None else out.when(cond, result)
    return out.otherwise(other)


def has_any(c: Column, words: list[str]) -> Column:
    return c.rlike("|".join(words))


def starts_any(c: Column, words: list[str]) -> Column:
    return c.rlike("^(" + "|".join(words) + ")")


def service_name(c: Column | str) -> Column:
    """Without `service.` or `external.`, underscores as hyphens, scheme and path of URLs and cluster suffixes removed."""
    s = F.regexp_replace(text(c), r"^service\.", "")
    s = F.translate(F.regexp_replace(s, r"^external\.", ""), "_", "-")
    s = F.regexp_replace(s, r"^https?://([^/]+).*$", "$1")
    return F.regexp_replace(F.regexp_replace(s, r"/+$", ""), CLUSTER_SUFFIXES, "")


def service_aliases(c: Column | str) -> Column:
    """Spelling variants of a service name in order of preference, lower case, distinct."""
    n = service_name(c)
    dash, under = F.translate(n, "_", "-"), F.translate(n, "-", "_")
    base = [n, dash, under, F.translate(n, ".", "-"), F.translate(n, ".", "_"), F.translate(n, "._", "--"), F.translate(n, ".-", "__")]
    more = []
    for b in base:
        more += [F.translate(b, "-", ""), F.translate(b, "_", ""), F.translate(b, ".", "")]
        more.append(F.when(F.contains(b, F.lit("catalogue")), F.replace(b, F.lit("catalogue"), F.lit("catalog"))).when(F.contains(b, F.lit("catalog")), F.replace(b, F.lit("catalog"), F.lit("catalogue"))).otherwise(""))
        more.append(F.when(F.endswith(b, F.lit("-api")), F.regexp_replace(b, "-api$", "")).when(b != "", F.concat(b, F.lit("-api"))).otherwise(""))
    return F.filter(F.array_distinct(F.transform(F.array(*base, *more), lambda x: F.lower(F.trim(x)))), lambda x: x != "")


def identifier(c: Column | str) -> Column:
    """Lower case with everything but letters, digits, hyphen and underscore as underscore."""
    return F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), r"[^a-z0-9_-]", "_")


def _unquoted(c: Column | str) -> Column:
    return F.lower(F.trim(F.btrim(F.coalesce(col(c), F.lit("")), F.lit("\"'"))))


def _queue_tail(s: Column) -> Column:
    s = F.regexp_replace(F.trim(F.regexp_replace(s, "^queue:", "")), r"^arn:.*:([^:]+)$", "$1")
    return F.regexp_replace(s, r"^[a-z][a-z0-9+.-]*://[^/?#]*/(?:[^?#]*/)?([^/?#]+)/*(?:[?#].*)?$", "$1")


def _separated(c: Column | str, drop: str, fifo: str) -> Column:
    s = F.regexp_replace(_queue_tail(_unquoted(c)), r"\.fifo$", "\u0001")
    return F.replace(F.regexp_replace(s, drop, ""), F.lit("\u0001"), F.lit(fifo))


def queue_key(c: Column | str) -> Column:
    """Graph form: letters and digits only, `_fifo` for FIFO queues."""
    return _separated(c, r"[^a-z0-9\u0001]", "_fifo")


def queue_topic(c: Column | str) -> Column:
    """Resolver form: separators removed, the FIFO suffix dropped."""
    return _separated(c, r"[-_.]+", "")


def queue_route(c: Column | str) -> Column:
    """Flow form: separators removed, `.fifo` kept."""
    return _separated(c, r"[-_.]+", ".fifo")


def scoped_queue(key: Column, service: Column, source: Column) -> Column:
    """Generic and fallback names are only unique inside their service."""
    generic = key.isin(*GENERIC_QUEUES) | (F.length(key) < 5) | F.coalesce(source.isin("config_key", "raw"), F.lit(False))
    return F.when(generic, F.concat_ws(":", identifier(queue_key(service)), key)).otherwise(key)


def queue_destination(c: Column | str) -> Column:
    """Without a consumer or listener suffix and trailing separators."""
    return F.regexp_replace(F.regexp_replace(lower(c), QUEUE_SUFFIXES, ""), r"[-_.]+$", "")


def placeholder_default(c: Column | str) -> Column:
    """`${VAR:default}` as its default."""
    return F.regexp_replace(F.coalesce(col(c), F.lit("")), r"\$\{[^:}]+:([^}]*)\}", "$1")


def route_path(c: Column | str) -> Column:
    """Path of a route or URL template: defaults expanded, host and query dropped; '' unless it starts with a slash."""
    s = placeholder_default(F.trim(F.btrim(F.coalesce(col(c), F.lit("")), F.lit("\"'"))))
    s = F.when(F.contains(s, F.lit("://")), F.regexp_replace(s, r"\$\{[^}]+\}", "placeholder")).otherwise(s)
    s = F.regexp_replace(F.regexp_replace(s, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(?=/)", ""), r"^\$\{[^}]*\}(?=/)", "")
    return F.regexp_extract(F.regexp_replace(s, r"\?.*$", ""), r"(?s)^(/.*)$", 1)


def route_normal(c: Column | str) -> Column:
    """Route identity of the graph: lower case, parameters as {}, single slashes, no closing slash."""
    s = F.regexp_replace(F.lower(F.trim(route_path(c))), r"\$\{[^}]+\}|\{[^}/]+\}|:[a-z_][a-z0-9_]*", "{}")
    return F.regexp_replace(F.regexp_replace(s, r"/+", "/"), r"(?<=.)/$", "")


def route_canonical(c: Column | str) -> Column:
    """Route identity of facts: whole segments that are parameters in any framework's notation become {}."""
    s = F.regexp_replace(F.regexp_replace(lower(c), r"^(?=[^/])", "/"), r"/+", "/")
    s = F.regexp_replace(s, r"(?<=/)(\*\*?|:[^/]*|\{[^/]*\}|<[^/]*>)(?=/|$)", "{}")
    return F.regexp_replace(s, r"(?<=.)/$", "")


def route_stripped(c: Column) -> Column:
    """Without leading segments that only say version or audience."""
    return F.regexp_replace(c, r"^(/(api|v1|v2|public|internal))+(?=/)", "")


def http_method(c: Column | str) -> Column:
    """Method named in free text before a path, upper case; '' if none."""
    return F.upper(F.regexp_extract(text(c), r"(?i)\b(GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)\s+\S+", 1))


def http_path(c: Column | str) -> Column:
    return route_path(F.regexp_extract(text(c), r"(?i)\b(?:GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)\s+(\S+)", 1))


def hostname(c: Column | str) -> Column:
    """Host identity: scheme, user information, path, port and cluster suffixes removed."""
    s = F.regexp_replace(lower(c), r"^(jdbc:)?[a-z][a-z0-9+.-]*://", "")
    s = F.regexp_replace(F.regexp_replace(s, r"[/?#].*$", ""), r"^[^@]*@", "")
    return F.regexp_replace(F.regexp_replace(s, r":\d+$", ""), CLUSTER_SUFFIXES, "")


def lookup(c: Column | str) -> Column:
    """Search form: lower case, underscores as hyphens, other signs as one blank."""
    s = F.regexp_replace(F.translate(lower(c), "_", "-"), r"[^a-z0-9/{}.:-]+", " ")
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def db_kind(c: Column | str) -> Column:
    s = F.lower(F.coalesce(col(c), F.lit("")))
    return ladder(s, [(s.rlike("postgres"), "postgresql"), (s.rlike("s3|bucket"), "s3"), (s.rlike("dynamo"), "dynamodb"), (s.rlike("redis"), "redis"), (s.rlike("athena"), "athena"), (s.rlike("elastic|opensearch"), "elasticsearch"), (s.rlike("mongo"), "mongodb")], s)


def cache_kind(kind: Column | str, name: Column | str) -> Column:
    k = F.coalesce(col(kind), F.lit(""))
    s = F.lower(F.concat_ws(" ", k, F.coalesce(col(name), F.lit(""))))
    return ladder(s, [(s.rlike("redis"), "redis"), (s.rlike("memcache"), "memcached"), (F.lower(F.trim(k)).isin("", "database"), "cache")], F.lower(F.trim(k)))


def queue_kind(*cs: Column | str) -> Column:
    s = F.lower(F.concat_ws(" ", *(F.coalesce(col(c), F.lit("")) for c in cs)))
    steps = [(s.rlike("dynamodb.*stream|stream.*dynamodb"), "dynamodb_stream"), (s.rlike("sqs"), "sqs"), (s.rlike("sns"), "sns"), (s.rlike("kafka"), "kafka"), (s.rlike("kinesis"), "kinesis"), (s.rlike("rabbit"), "rabbitmq")]
    return ladder(s, steps, F.lit("queue"))


def operation(c: Column | str) -> Column:
    """Verb class of a datastore operation: read, write, delete, or the verb itself."""
    s = lower(c)
    steps = [
        (s == "", ""), (starts_any(s, READ_VERBS), "read"), (starts_any(s, DELETE_VERBS), "delete"), (starts_any(s, WRITE_VERBS), "write"),
        (s.rlike("delete|remove|truncate"), "delete"), (s.rlike("insert|update|upsert|persist|merge"), "write"), (s.rlike("select|findby|fetch|search|exists|query"), "read"),
    ]
    return ladder(s, steps, s)


def direction(c: Column | str) -> Column:
    """write, read or ''; a label that says both writes."""
    s = F.lower(F.coalesce(col(c), F.lit("")))
    return F.when(has_any(s, WRITE_WORDS), "write").when(has_any(s, READ_WORDS), "read").otherwise("")


def singular(c: Column | str) -> Column:
    """Conservative singular of a resource name."""
    s = lower(c)
    keep = (F.length(s) < 4) | ~F.endswith(s, F.lit("s")) | s.isin(*UNCOUNTABLE) | s.rlike("(ss|us|is|ous)$")
    return (
        F.when(keep, s).when(s.rlike("ies$") & (F.length(s) > 4), F.regexp_replace(s, "ies$", "y"))
        .when(s.rlike("ses$") & (F.length(s) > 4), F.regexp_replace(s, "es$", "")).otherwise(F.regexp_replace(s, "s$", ""))
    )


def platform_class(c: Column | str) -> Column:
    """Engine class; placeholders that say nothing are ''."""
    s = lower(c)
    return ladder(s, [(F.contains(s, F.lit(a)), b) for a, b in PLATFORM_CLASSES] + [(s.isin(*GENERIC_PLATFORMS), "")], s)


def priority(t: Column | str) -> Column:
    """How much a kind of fact is preferred when two describe one thing."""
    t = col(t)
    return (
        F.when(t == "queue_publish", 40)
        .when(t.isin("queue_consumer", "scheduled_job", "webhook", "rpc_endpoint", "outbound_http", "outbound_rpc", "workflow_orchestration", "db_operation", "cache_operation"), 30)
        .when(t.isin("http_route", "stream_consume"), 20).when(t.isin("cli_command", "command_exec"), 10).otherwise(1)
    )


def match_type(t: Column | str) -> Column:
    t = lower(t)
    return ladder(t, [(t.rlike("http"), "http"), (t.rlike("rpc"), "rpc"), (t.rlike("queue|stream"), "queue"), (t.rlike("db|cache"), "shared_db")], F.lit("other"))


def config_profile(c: Column | str) -> Column:
    """Profile that a configuration file's name or folder says; '' for the default one."""
    p = F.regexp_replace(lower(c), r":.*$", "")
    found = F.coalesce(*(F.nullif(F.regexp_extract(p, r, 1), F.lit("")) for r in (r"application-([a-z0-9]+)\.", r"\.env\.([a-z0-9]+)$", r"(?:env|deploy|config|environments?)/([a-z0-9]+)(?:\.|/)")), F.lit(""))
    return F.when(found.isin("default", "base", "common", "application", "values"), F.lit("")).otherwise(found)


def snake(c: Column | str) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.coalesce(col(c), F.lit("")), r"([A-Z]+)([A-Z][a-z])", "$1_$2"), r"([a-z0-9])([A-Z])", "$1_$2")
    return F.lower(F.regexp_replace(s, r"[\s.-]+", "_"))


def plural(c: Column) -> Column:
    return (
        F.when(c == "", c).when(c.rlike("[^aeiou]y$"), F.regexp_replace(c, "y$", "ies")).when(c.rlike("(s|x|z|ch|sh)$"), F.concat(c, F.lit("es"))).otherwise(F.concat(c, F.lit("s")))
    )


def static_suffix(c: Column | str) -> Column:
    """What a template leaves when its holes are cut out; '' with fewer than four letters."""
    s = F.regexp_replace(F.coalesce(col(c), F.lit("")), r"\{\{[^}]*\}\}|\$\{[^}]*\}", "")
    s = F.btrim(F.regexp_replace(s, r"[-_./]{2,}", "-"), F.lit("-_./"))
    return F.when(F.length(F.regexp_replace(s, r"[^A-Za-z]", "")) >= 4, s).otherwise(F.lit(""))


def last_segment(c: Column | str) -> Column:
    """Tail of a URL, ARN or dotted key."""
    return F.regexp_extract(F.regexp_replace(text(c), r"[?#].*$", ""), r"([^/:.]+)[/:.]*$", 1)


def all_of(cs: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, cs)
