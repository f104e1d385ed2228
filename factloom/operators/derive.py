"""Facts from source text: a table of detectors over call sites, evaluated in one pass, every hit of a text.

A detector says what a framework's source looks like: one expression with the fact's name in one group and its detail (verb,
method) in another. All detectors run as built-in expressions over one scan; adding a framework adds a row.

Defined results: null and blank texts give nothing; a group that takes no part gives ''; a text that several detectors of
one fact type read alike gives each framework once.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Detector(NamedTuple):
    fact_type: str
    framework: str
    language: str
    pattern: str
    name: int = 1
    detail: int = 0  # no detail


_Q, _S = r"""["'`]""", r"""[^"'`]"""
_VERB = "get|post|put|patch|delete"
DETECTORS: tuple[Detector, ...] = (
    # routes
    Detector("http_route", "spring", "Java", r'@(Get|Post|Put|Patch|Delete|Request)Mapping\s*\(\s*(?:(?:value|path)\s*=\s*)?\{?\s*"([^"]+)"', 2, 1),
    Detector("http_route", "jax-rs", "Java", r'@Path\s*\(\s*"([^"]+)"'),
    Detector("http_route", "ktor", "Kotlin", rf'\b({_VERB})\s*\(\s*"(/[^"]*)"\s*\)\s*\{{', 2, 1),
    Detector("http_route", "express", "JavaScript", rf"(?:^|[^@\w.])(?:app|router)\.({_VERB}|all)\s*\(\s*{_Q}(/{_S}*)", 2, 1),
    Detector("http_route", "nestjs", "TypeScript", rf"@(Get|Post|Put|Patch|Delete|All)\s*\(\s*{_Q}({_S}*)", 2, 1),
    Detector("http_route", "fastapi", "Python", rf"""@\w+\.({_VERB})\s*\(\s*["']([^"']+)""", 2, 1),
    Detector("http_route", "flask", "Python", r"""@\w+\.route\s*\(\s*["']([^"']+)["'](?:[^)]*methods\s*=\s*\[\s*["'](\w+))?""", 1, 2),
    Detector("http_route", "django", "Python", r"""\b(?:re_)?path\s*\(\s*r?["']([^"']*)["']\s*,"""),
    Detector("http_route", "net/http", "Go", r'\bhttp\.Handle(?:Func)?\s*\(\s*"(?:([A-Z]+) )?([^"]+)"', 2, 1),
    Detector("http_route", "gorilla", "Go", r'\brouter\.Handle(?:Func)?\s*\(\s*"([^"]+)"(?:[^;\n]*?\.Methods\(\s*"([A-Z]+)")?', 1, 2),
    Detector("http_route", "gin", "Go", r'\b(?:r|e|g|app|engine|group|api|v\d+)\.(GET|POST|PUT|PATCH|DELETE)\s*\(\s*"([^"]+)"', 2, 1),
    Detector("http_route", "chi", "Go", r'\b(?:r|e|g|app|mux|group|api|v\d+)\.(Get|Post|Put|Patch|Delete)\s*\(\s*"([^"]+)"', 2, 1),
    Detector("http_route", "rails", "Ruby", rf"""(?m)^\s*({_VERB})\s+["']([^"']+)["']""", 2, 1),
    Detector("http_route", "laravel", "PHP", rf"""\bRoute::({_VERB})\s*\(\s*["']([^"']+)""", 2, 1),
    Detector("http_route", "asp.net", "C#", r'(?:\[Http|\.Map)(Get|Post|Put|Patch|Delete)\s*\(\s*"([^"]+)"', 2, 1),
    # stores
    Detector("db_operation", "sql", "SQL", r"""(?i)(?:^|["'`(=]\s*)\s*(select)\b[^;"'`]*?\bfrom\s+([A-Za-z_][\w.]*)""", 2, 1),
    Detector("db_operation", "sql", "SQL", r"""(?i)(?:^|["'`(=]\s*)\s*(insert)\s+into\s+([A-Za-z_][\w.]*)""", 2, 1),
    Detector("db_operation", "sql", "SQL", r"""(?i)(?:^|["'`(=]\s*)\s*(update)\s+([A-Za-z_][\w.]*)\s+set\b""", 2, 1),
    Detector("db_operation", "sql", "SQL", r"""(?i)(?:^|["'`(=]\s*)\s*(delete)\s+from\s+([A-Za-z_][\w.]*)""", 2, 1),
    Detector("db_operation", "jpa", "Java", r"\b(\w+)Repository\.(find\w*|get\w*|save\w*|delete\w*|count\w*|exists\w*)\s*\(", 1, 2),
    Detector("db_operation", "sqlalchemy", "Python", r"\bsession\.(query|get|add|delete)\s*\(\s*([A-Z]\w*)", 2, 1),
    Detector("db_operation", "django-orm", "Python", r"\b([A-Z]\w*)\.objects\.(\w+)\s*\(", 1, 2),
    Detector("db_operation", "prisma", "TypeScript", r"\bprisma\.(\w+)\.(\w+)\s*\(", 1, 2),
    Detector("db_operation", "sequelize", "JavaScript", r"\b([A-Z]\w*)\.(findAll|findOne|findByPk|bulkCreate|destroy|upsert)\s*\(", 1, 2),
    Detector("db_operation", "gorm", "Go", r"\bdb\.(?:WithContext\(\w+\)\.)?(?:Model|Table)\s*\(\s*[&\"]*(\w+)"),
    Detector("db_operation", "active-record", "Ruby", r"\b([A-Z]\w*)\.(where|find_by|find_or_create_by|update_all|destroy_all|insert_all)\b", 1, 2),
    Detector("db_operation", "dynamodb", "any", r"""\bTableName["']?\s*[:=]\s*(?:aws\.String\(\s*)?["']([^"']+)"""),
    Detector("db_operation", "repository", "Go", r"\brepo\.()(\w+)\s*\(", 1, 2),
    # queues and streams
    Detector("queue_publish", "publisher", "any", rf"\bpublisher\.(send|publish)\s*\(\s*{_Q}({_S}+)", 2, 1),
    Detector("queue_publish", "kafka", "any", rf"\b(?:kafkaTemplate|kafka|producer)\.(send|produce)\s*\(\s*(?:new\s+ProducerRecord[^(]*\(\s*|\{{\s*topic\s*:\s*)?{_Q}({_S}+)", 2, 1),
    Detector("queue_publish", "sqs", "any", r"""(?i)\bsend_?message\w*\b[^;]*?\bQueueUrl["']?\s*[:=]\s*(?:aws\.String\(\s*)?["']([^"']+)"""),
    Detector("queue_publish", "sns", "any", r"""\bTopicArn["']?\s*[:=]\s*(?:aws\.String\(\s*)?["']([^"']+)"""),
    Detector("queue_publish", "rabbitmq", "any", r"""\b(?:rabbitTemplate\.convertAndSend\s*\(\s*|basic_publish\s*\([^)]*routing_key\s*=\s*|channel\.sendToQueue\s*\(\s*)["']([^"']+)"""),
    Detector("queue_consumer", "kafka", "any", r"""(?:@KafkaListener\s*\([^)]*?topics\s*=\s*\{?\s*|\bconsumer\.subscribe\s*\(\s*\[?\s*(?:\{\s*topics?\s*:\s*\[?\s*)?)["']([^"']+)"""),
    Detector("queue_consumer", "sqs", "any", r"""(?:@SqsListener\s*\(\s*(?:value\s*=\s*|queueNames\s*=\s*)?|(?i:receive_?message)\w*\b[^;]*?\bQueueUrl["']?\s*[:=]\s*)["']([^"']+)"""),
    Detector("queue_consumer", "rabbitmq", "any", r"""(?:@RabbitListener\s*\([^)]*?queues\s*=\s*|basic_consume\s*\([^)]*?queue\s*=\s*|channel\.consume\s*\(\s*)["']([^"']+)"""),
    # calls to others
    Detector("outbound_http", "url-literal", "any", r"""["'`](https?://[^"'`/?${\s]+)"""),
    Detector("outbound_http", "rest-template", "Java", r'\brestTemplate\.(\w+)\s*\(\s*"([^"]+)"', 2, 1),
    Detector("outbound_http", "web-client", "Java", r'\b[wW]ebClient\b[^;]*?\.(get|post|put|patch|delete)\(\)[^;]*?\.uri\(\s*"([^"]+)"', 2, 1),
    Detector("outbound_http", "feign", "Java", r'@FeignClient\s*\([^)]*?(?:name|value|url)\s*=\s*"([^"]+)"'),
    Detector("outbound_http", "axios", "JavaScript", rf"\baxios\.({_VERB})\s*\(\s*{_Q}({_S}+)", 2, 1),
    Detector("outbound_http", "fetch", "JavaScript", rf"\bfetch\s*\(\s*{_Q}({_S}+)"),
    Detector("outbound_http", "requests", "Python", rf"""\b(?:requests|httpx|session)\.({_VERB})\s*\(\s*f?["']([^"']+)""", 2, 1),
    Detector("outbound_http", "net/http", "Go", r'\bhttp\.(Get|Post|Head)\s*\(\s*"([^"]+)"', 2, 1),
    Detector("outbound_http", "net/http", "Go", r'\bhttp\.NewRequest(?:WithContext)?\s*\(\s*(?:\w+\s*,\s*)?"([A-Z]+)"\s*,\s*"([^"]+)"', 2, 1),
    Detector("outbound_rpc", "grpc", "any", r"""\b(?:grpc\.(?:Dial|DialContext|NewClient)\s*\(\s*(?:ctx\s*,\s*)?|(?:in)?secure_channel\s*\(\s*|ManagedChannelBuilder\.forTarget\s*\(\s*)["']([^"']+)"""),
    Detector("cache_operation", "cache", "any", rf"\bcache\.(get|set|put|evict|delete)\s*\(\s*{_Q}([^:\"'`]+)", 2, 1),
    Detector("cache_operation", "redis", "any", rf"\b(?:redis|rdb|redisTemplate|redisClient|jedis)\.(\w+)\s*\(\s*(?:ctx\s*,\s*)?{_Q}([^:\"'`]+)", 2, 1),
    Detector("object_storage", "s3", "any", r"""(?i)\b(put_?object|get_?object|delete_?object|list_?objects(?:_?v2)?)\w*\b[^;]*?\bBucket["']?\s*[:=]\s*(?:aws\.String\(\s*)?["']([^"']+)""", 2, 1),
    Detector("command_exec", "exec", "any", r"""\b(?:exec\.Command(?:Context)?\s*\(\s*(?:ctx\s*,\s*)?|subprocess\.(?:run|call|check_call|check_output|Popen)\s*\(\s*\[?\s*|Runtime\.getRuntime\(\)\.exec\s*\(\s*|child_process\.\w+\s*\(\s*)["'`]([^"'`]+)"""),
    Detector("scheduled_job", "cron", "any", r"""(?:\bcron:\s*|@Scheduled\s*\([^)]*?cron\s*=\s*|\bcron\.schedule\s*\(\s*|\b\w*[cC]ron\.AddFunc\s*\(\s*)["']([^"']+)"""),
    Detector("cli_command", "cli", "any", r"""(?:&?cobra\.Command\s*\{[^}]*?\bUse:\s*|@\w+\.command\s*\(\s*(?:name\s*=\s*)?|@Command\s*\([^)]*?name\s*=\s*)["']([\w:-]+)"""),
    Detector("workflow_call", "temporal", "any", r"""\b(?:workflow\.ExecuteActivity|client\.ExecuteWorkflow)\s*\([^,]*,\s*(?:[^,]*,\s*)?([A-Za-z_][\w.]*)"""),
)


def _hits(text: Column, d: Detector) -> Column:
    """array<struct<fact_type, framework, language, name, detail>> of one detector."""
    name = F.regexp_extract_all(text, F.lit(d.pattern), F.lit(d.name))
    make = lambda n, x: F.struct(F.lit(d.fact_type).alias("fact_type"), F.lit(d.framework).alias("framework"), F.lit(d.language).alias("language"), n.alias("name"), F.lower(x).alias("detail"))
    if not d.detail:
        return F.transform(name, lambda n: make(n, F.lit("")))
    return F.zip_with(name, F.regexp_extract_all(text, F.lit(d.pattern), F.lit(d.detail)), make)


def call_facts(sites: DataFrame, keys: list[str], text: str = "snippet", types: tuple[str, ...] | None = None) -> DataFrame:
    """(keys..., fact_type, framework, language, name, detail): everything the detectors read in a call site's text."""
    own = [d for d in DETECTORS if types is None or d.fact_type in types]
    hits = F.array_distinct(F.concat(*(_hits(F.col(text), d) for d in own)))
    return sites.where(F.trim(text) != "").select(*keys, F.explode(hits).alias("h")).select(*keys, "h.*")


#: What asks a caller for rights: annotations, guards, and looks at its header.
AUTH = r"""@(?:PreAuthorize|Secured|RolesAllowed|UseGuards|login_required|requires_auth|jwt_required|Authorize)\b|\[Authorize\b|(?i:getHeader\(\s*["']authorization["'])|(?i:headers\[\s*["']authorization["']\])"""
#: Parameters of a handler and where they come from.
PARAMETERS = r"""@(RequestParam|PathVariable|RequestHeader|QueryParam|PathParam|HeaderParam|Query|Param|Headers|Body|RequestBody)\s*\(\s*(?:(?:value|name)\s*=\s*)?["']([^"']+)"""
PLACES = {"requestparam": "query", "queryparam": "query", "query": "query", "pathvariable": "path", "pathparam": "path", "param": "path", "requestheader": "header", "headerparam": "header", "headers": "header", "body": "body", "requestbody": "body"}


def enrichments(sites: DataFrame, keys: list[str], text: str = "snippet") -> DataFrame:
    """(keys..., what, place, name): what a handler's text asks of its caller, and the parameters that it binds."""
    t = F.col(text)
    auth = F.transform(F.regexp_extract_all(t, F.lit(AUTH), F.lit(0)), lambda x: F.struct(F.lit("auth").alias("what"), F.lit("").alias("place"), F.lower(F.regexp_replace(x, r"[@\[]|\(.*$", "")).alias("name")))
    place = F.create_map(*[F.lit(x) for kv in PLACES.items() for x in kv])
    bound = F.zip_with(F.regexp_extract_all(t, F.lit(PARAMETERS), F.lit(1)), F.regexp_extract_all(t, F.lit(PARAMETERS), F.lit(2)), lambda p, n: F.struct(F.lit("parameter").alias("what"), place[F.lower(p)].alias("place"), n.alias("name")))
    return sites.where(F.trim(text) != "").select(*keys, F.explode(F.array_distinct(F.concat(auth, bound))).alias("h")).select(*keys, "h.*")


def looks_like_cron(c: Column) -> Column:
    """Five or six fields of a cron expression."""
    return c.rlike(r"^\s*(?:[\d*/,\-?LW#]+\s+){4,5}[\d*/,\-?LW#A-Z]+\s*$")
