"""Repository files as tables: scan, configuration entries, contracts, infrastructure links, markers and metrics.

Files are read with the binaryFile source, filtered on path and length before their content is used; parsing runs in
Arrow batches. Defined results: unreadable, oversized and binary files give no rows; malformed documents give the
entries before the first error (properties, env) or none (YAML, JSON, TOML); empty folders give empty tables.
"""

from __future__ import annotations

import json
import re
from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators.predicates import TEST_LIKE

#: What a scan leaves out, and languages by extension with the weight of a line.
SKIP_DIRS = r"(^|/)(\.git|\.hg|\.svn|node_modules|vendor|dist|build|target|out|bin|\.venv|venv|__pycache__|\.idea|\.gradle|coverage)/"
MAX_BYTES = 4 * 1024 * 1024
LANGUAGES = {
    "go": ("Go", 1.0), "java": ("Java", 1.0), "kt": ("Kotlin", 1.0), "py": ("Python", 1.0), "ts": ("TypeScript", 1.0), "js": ("JavaScript", 1.0), "rb": ("Ruby", 1.0), "rs": ("Rust", 1.0), "cs": ("C#", 1.0), "scala": ("Scala", 1.0), "php": ("PHP", 1.0),
    "sh": ("Shell", 0.5), "sql": ("SQL", 0.5), "tf": ("HCL", 0.5), "yaml": ("YAML", 0.1), "yml": ("YAML", 0.1), "json": ("JSON", 0.1), "toml": ("TOML", 0.1), "properties": ("Properties", 0.1), "md": ("Markdown", 0.1),
}
CONFIG_FORMATS = {"yaml": "yaml", "yml": "yaml", "json": "json", "properties": "properties", "env": "properties", "toml": "toml", "tf": "hcl", "hcl": "hcl"}
MARKERS = {"go.mod": "Go", "pom.xml": "Java", "build.gradle": "Java", "build.gradle.kts": "Kotlin", "package.json": "JavaScript", "pyproject.toml": "Python", "requirements.txt": "Python", "Cargo.toml": "Rust", "Gemfile": "Ruby", "composer.json": "PHP", "build.sbt": "Scala"}


def _map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for p in pairs.items() for x in p])


def extension(path: Column | str) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def language(path: Column | str) -> Column:
    return _map({k: v[0] for k, v in LANGUAGES.items()})[extension(path)]


def weight(path: Column | str) -> Column:
    return _map({k: v[1] for k, v in LANGUAGES.items()})[extension(path)]


def scan(spark: SparkSession, root: str, tests: bool = False) -> DataFrame:
    """(path, language, format, bytes, text) of a repository's files, path relative to root; hidden files are not read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rel = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/*", "/"), "^" + re.escape(root.rstrip("/")) + "/", "")
    f = f.where(F.col("length") <= MAX_BYTES).withColumn("rel", rel).where(~F.col("rel").rlike(SKIP_DIRS))
    if not tests:
        f = f.where(~F.col("rel").rlike(TEST_LIKE))
    f = f.where(F.is_valid_utf8("content"))
    return f.select(F.col("rel").alias("path"), language("rel").alias("language"), _map(CONFIG_FORMATS)[extension("rel")].alias("format"), F.col("length").alias("bytes"), F.decode("content", "UTF-8").alias("text"))


def metrics(files: DataFrame) -> DataFrame:
    """Files, lines that aren't blank, and weighted lines per language, the heaviest first."""
    loc = F.size(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""))
    g = files.where("language is not null").groupBy("language").agg(F.count("*").alias("files"), F.sum(loc).alias("loc"), F.round(F.sum(loc * weight("path")), 3).alias("weighted"))
    return g.orderBy(F.desc("weighted"), "language")


def markers(files: DataFrame) -> DataFrame:
    """(path, language, version) told by build files."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    version = F.coalesce(*(F.nullif(F.regexp_extract("text", r, 1), F.lit("")) for r in (r"(?m)^go\s+([\d.]+)", r"<java\.version>([^<]+)<", r"sourceCompatibility\s*=\s*['\"]?([\d.]+)", r"requires-python\s*=\s*\"([^\"]+)\"", r"\"node\"\s*:\s*\"([^\"]+)\"", r"(?m)^edition\s*=\s*\"(\d+)\"")))
    return files.select("path", _map(MARKERS)[name].alias("language"), version.alias("version")).where("language is not null")


def _flat(value, prefix: str = ""):
    if isinstance(value, dict):
        for k, v in value.items():
            yield from _flat(v, f"{prefix}.{k}" if prefix else str(k))
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from _flat(v, f"{prefix}[{i}]")
    elif prefix:
        yield prefix, "" if value is None else "true" if value is True else "false" if value is False else str(value)


def entries(text: str | None, kind: str | None):
    """(key, value, line, profile) of one configuration text."""
    if not text or not kind:
        return
    if kind == "properties":
        for n, line in enumerate(text.split("\n"), 1):
            m = re.match(r"^\s*(?:export\s+)?([A-Za-z_][\w.\-\[\]]*)\s*[=:]\s*(.*?)\s*$", line)
            if m and not line.lstrip().startswith(("#", "!")):
                yield m[1], m[2].strip("\"'"), n, ""
    elif kind == "json":
        try:
            for k, v in _flat(json.loads(text)):
                yield k, v, 0, ""
        except ValueError:
            return
    elif kind == "toml":
        import tomllib

        try:
            for k, v in _flat(tomllib.loads(text)):
                yield k, v, 0, ""
        except tomllib.TOMLDecodeError:
            return
    elif kind == "yaml":
        import yaml

        offset = 1
        for doc in re.split(r"(?m)^---[^\n]*\n?", text):
            try:
                value = yaml.safe_load(doc)
            except (yaml.YAMLError, ValueError):
                value = None
            flat = list(_flat(value)) if isinstance(value, (dict, list)) else []
            active = {"spring.config.activate.on-profile", "spring.profiles", "profile"}
            profile = next((v for k, v in flat if k in active), "")
            for k, v in flat:
                leaf = re.sub(r"\[\d+\]$", "", k).rsplit(".", 1)[-1]
                m = re.search(rf"(?m)^\s*(?:-\s*)?[\"']?{re.escape(leaf)}[\"']?\s*:", doc)
                yield k, v, offset + doc[: m.start()].count("\n") if m else offset, profile
            offset += doc.count("\n") + 1
    elif kind == "hcl":
        stack: list[str] = []
        for n, line in enumerate(text.split("\n"), 1):
            line = re.sub(r"(^|\s)(#|//).*$", "", line)
            if m := re.match(r'^\s*([\w-]+)((?:\s+"[^"]*")*)\s*\{\s*$', line):
                stack.append(".".join([m[1], *re.findall(r'"([^"]*)"', m[2])]))
            elif re.match(r"^\s*\}\s*$", line):
                stack = stack[:-1]
            elif m := re.match(r"^\s*([\w-]+)\s*=\s*(.+?)\s*$", line):
                yield ".".join([*stack, m[1]]), m[2].strip('"'), n, ""


def config_entries(files: DataFrame, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """(keys..., key, value, line, profile) of files(keys..., format, text)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import IntegerType, StringType, StructField, StructType

    own = files.select(*keys, "format", "text")
    schema = StructType([*(own.schema[k] for k in keys), StructField("key", StringType()), StructField("value", StringType()), StructField("line", IntegerType()), StructField("profile", StringType())])
    arrow = to_arrow_schema(schema)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            out = [(*row[:-2], *e) for row in zip(*(c.to_pylist() for c in b.columns)) for e in entries(row[-1], row[-2])]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    return own.mapInArrow(run, schema)


def terraform_subscriptions(files: DataFrame) -> DataFrame:
    """(topic, queue, path): queue subscriptions declared in Terraform, names resolved through the resources."""
    tf = files.where("format = 'hcl'").select("path", "text")

    def blocks(kind: str, *fields: str) -> DataFrame:
        b = tf.select("path", F.explode(F.regexp_extract_all("text", F.lit(rf'(?s)resource\s+"{kind}"\s+"[^"]+"\s*\{{.*?\n\}}'), F.lit(0))).alias("b"))
        return b.select("path", F.regexp_extract("b", r'resource\s+"[^"]+"\s+"([^"]+)"', 1).alias("resource"), *(F.regexp_extract("b", rf'(?m)^\s*{f}\s*=\s*"?([^"\n]+?)"?\s*$', 1).alias(f) for f in fields))

    topics = blocks("aws_sns_topic", "name").select(F.col("resource").alias("t"), F.col("name").alias("topic"))
    queues = blocks("aws_sqs_queue", "name").select(F.col("resource").alias("q"), F.col("name").alias("queue"))
    subs = blocks("aws_sns_topic_subscription", "topic_arn", "endpoint")
    ref = lambda c: F.regexp_extract(c, r"aws_(?:sns_topic|sqs_queue)\.([\w-]+)\.", 1)
    return subs.withColumn("t", ref("topic_arn")).withColumn("q", ref("endpoint")).join(topics, "t").join(queues, "q").select("topic", "queue", "path").distinct()


def openapi_fields(files: DataFrame, depth: int = 8, most: int = 1000) -> DataFrame:
    """(path, method, route, location, name, type, required, truncated) of OpenAPI documents; local references only.

    depth bounds the nesting, most the fields of one document, because references can multiply them without end; truncated
    marks all rows of a document of which either left something out.
    """

    def schema_fields(doc, s, location, prefix, level, seen):
        if not isinstance(s, dict):
            return
        if level > depth:
            yield None
            return
        if "$ref" in s:
            r = s["$ref"]
            if not isinstance(r, str) or not r.startswith("#/") or r in seen:
                return
            node = doc
            for part in r[2:].split("/"):
                node = node.get(part.replace("~1", "/").replace("~0", "~")) if isinstance(node, dict) else None
            yield from schema_fields(doc, node, location, prefix, level + 1, seen | {r})
            return
        for sub in (*(s.get("allOf") or ()), *(s.get("oneOf") or ()), *(s.get("anyOf") or ())):
            yield from schema_fields(doc, sub, location, prefix, level + 1, seen)
        if isinstance(s.get("items"), dict):
            yield from schema_fields(doc, s["items"], location, prefix, level + 1, seen)
        for k, v in (s.get("properties") or {}).items():
            name = f"{prefix}.{k}" if prefix else k
            yield location, name, str((v or {}).get("type", "object")) if isinstance(v, dict) else "", k in (s.get("required") or [])
            yield from schema_fields(doc, v, location, name, level + 1, seen)

    def rows(path, text):
        import yaml

        try:
            doc = json.loads(text) if text.lstrip().startswith("{") else yaml.safe_load(text)
        except (ValueError, yaml.YAMLError):
            return
        if not isinstance(doc, dict) or not str(doc.get("openapi", "")).startswith("3"):
            return
        out, cut_off = [], False
        for route, ops in (doc.get("paths") or {}).items():
            for method, op in (ops or {}).items():
                if method not in ("get", "post", "put", "patch", "delete", "head", "options") or not isinstance(op, dict):
                    continue
                found = [(str(p.get("in")), str(p.get("name")), str((p.get("schema") or {}).get("type", "")), bool(p.get("required"))) for p in op.get("parameters") or () if isinstance(p, dict) and "name" in p]
                bodies = (schema_fields(doc, (media or {}).get("schema"), "body", "", 0, frozenset()) for media in ((op.get("requestBody") or {}).get("content") or {}).values())
                for f in chain(found, *bodies):
                    if f is None or len(out) >= most:
                        cut_off = True
                        if len(out) >= most:
                            break
                        continue
                    out.append((path, method.upper(), route, *f))
        yield from ((*r, cut_off) for r in out)

    schema = "path string, method string, route string, location string, name string, type string, required boolean, truncated boolean"

    def run(batches):
        import pandas as pd

        for b in batches:
            yield pd.DataFrame([r for p, t in zip(b["path"], b["text"]) for r in rows(p, t or "")], columns=["path", "method", "route", "location", "name", "type", "required", "truncated"])

    return files.where("format in ('yaml', 'json')").select("path", "text").mapInPandas(run, schema).distinct()
