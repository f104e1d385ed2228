"""Declarative rule packs: loaded and validated on the driver, turned into expressions, run as one pass over the files.

A pack is a mapping with id, priority, applies_to (kind, has_file, name), extractions (strategy regex or field_path),
and resolution rules. Packs are stated by people; there are few, and none holds code.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators.predicates import glob_regex

BUILT_IN_PRIORITY = -1000
#: Bytes of a file that packs read, and values of one pack; fixed values.
MAX_FILE, MAX_VALUES = 2 * 1024 * 1024, 10_000


@dataclass(frozen=True)
class Pack:
    id: str
    priority: int = 0
    name: str = ""
    files: tuple[str, ...] = ()
    extractions: tuple[dict, ...] = ()
    rules: tuple[dict, ...] = ()
    problems: tuple[str, ...] = field(default=())
    tests: tuple[dict, ...] = ()


def parse(doc: dict) -> Pack:
    """The pack of a manifest; what is wrong with it is listed in problems."""
    bad = []
    if not re.fullmatch(r"[a-z0-9][a-z0-9._-]*", str(doc.get("id", ""))):
        bad.append("id")
    for i, e in enumerate(doc.get("extractions") or ()):
        if e.get("strategy") not in ("regex", "field_path"):
            bad.append(f"extractions[{i}].strategy")
        elif e["strategy"] == "regex":
            try:
                re.compile(e.get("pattern", ""))
            except re.error:
                bad.append(f"extractions[{i}].pattern")
        if not e.get("target"):
            bad.append(f"extractions[{i}].target")
    for i, r in enumerate(doc.get("resolution") or ()):
        if not r.get("target_pattern") or not r.get("service"):
            bad.append(f"resolution[{i}]")
    a = doc.get("applies_to") or {}
    return Pack(str(doc.get("id", "")), int(doc.get("priority", 0)), str(a.get("name", "")), tuple(a.get("has_file") or ()), tuple(doc.get("extractions") or ()), tuple(doc.get("resolution") or ()), tuple(bad), tuple(doc.get("tests") or ()))


def load(*folders: str) -> list[Pack]:
    """Valid packs of all manifests below the folders, highest priority first, then by id; the first of an id counts."""
    import yaml

    packs: dict[str, Pack] = {}
    for folder in folders:
        for p in sorted(Path(folder).rglob("pack.y*ml")):
            pack = parse(yaml.safe_load(p.read_text()) or {})
            if not pack.problems:
                packs.setdefault(pack.id, pack)
    return sorted(packs.values(), key=lambda x: (-x.priority, x.id))


def with_built_in(packs: list[Pack], built_in: list[Pack]) -> list[Pack]:
    """The packs and those built-in ones whose id nobody took."""
    known = {p.id for p in packs}
    extra = [Pack(p.id, BUILT_IN_PRIORITY, p.name, p.files, p.extractions, p.rules, (), p.tests) for p in built_in if p.id not in known]
    return sorted([*packs, *extra], key=lambda x: (-x.priority, x.id))


def applicable(files: DataFrame, packs: list[Pack], service: str = "service") -> DataFrame:
    """(service, pack_id): packs whose file globs and name glob fit a service's files(service, path)."""
    hits = []
    for p in packs:
        own = reduce(lambda a, b: a | b, (F.col("path").rlike(glob_regex(g)) for g in p.files), F.lit(not p.files))
        hits.append(F.when(own & (F.col(service).rlike(glob_regex(p.name)) if p.name else F.lit(True)), F.lit(p.id)))
    return files.select(service, F.explode(F.array_compact(F.array(*hits))).alias("pack_id")).distinct()


def field_path(variant: str, path: str) -> tuple[list[tuple[str, str]], str]:
    """A dotted path with * wildcards as steps: (variant path before a wildcard, ...) and the rest."""
    steps, now = [], "$"
    for part in path.split("."):
        if part == "*":
            steps.append((now, "*"))
            now = "$"
        else:
            m = re.fullmatch(r"([\w-]+)(?:\[(\d+)\])?", part)
            now += f"['{m[1]}']" + (f"[{m[2]}]" if m[2] else "")
    return steps, now


def extract(files: DataFrame, packs: list[Pack]) -> DataFrame:
    """(path, pack_id, target, value) of all extractions over files(path, text)."""
    out = []
    for p in packs:
        for e in p.extractions:
            own = files.where(F.col("path").rlike(glob_regex(e["glob"]))) if e.get("glob") else files
            head = [F.col("path"), F.lit(p.id).alias("pack_id"), F.lit(e["target"]).alias("target")]
            if e["strategy"] == "regex":
                g = 1 if re.compile(e["pattern"]).groups else 0
                out.append(own.select(*head, F.explode(F.regexp_extract_all("text", F.lit(e["pattern"]), F.lit(g))).alias("value")))
            else:
                df = own.select(*head, F.try_parse_json("text").alias("v"))
                steps, rest = field_path("v", e["path"])
                for at, _ in steps:
                    df = df.select("path", "pack_id", "target", F.explode(F.expr(f"try_variant_get(v, \"{at}\", 'array<variant>')")).alias("v"))
                out.append(df.select("path", "pack_id", "target", F.expr(f"try_variant_get(v, \"{rest}\", 'string')").alias("value")).where("value is not null"))
    if not out:
        return files.sparkSession.createDataFrame([], "path string, pack_id string, target string, value string")
    return reduce(DataFrame.unionByName, out).distinct()


def identity(values: DataFrame, packs: list[Pack]) -> DataFrame:
    """(path, target, value, conflict): scalars of the highest priority that agree; a conflict where they don't."""
    rank = {p.id: p.priority for p in packs}
    r = F.create_map(*[F.lit(x) for kv in rank.items() for x in kv])[F.col("pack_id")] if rank else F.lit(0)
    per = values.withColumn("priority", r).groupBy("path", "target", "priority").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    best = per.groupBy("path", "target").agg(F.max(F.struct("priority", "lo", "hi")).alias("b"))
    return best.select("path", "target", F.when(F.col("b.lo") == F.col("b.hi"), F.col("b.lo")).alias("value"), (F.col("b.lo") != F.col("b.hi")).alias("conflict"))


def limits(files: DataFrame, values: DataFrame) -> DataFrame:
    """(subject, name, amount): files over MAX_FILE bytes and packs with more than MAX_VALUES values, which a run must not take silently."""
    size = F.octet_length("text").cast("long")
    large = files.where(size > MAX_FILE).select(F.lit("file").alias("subject"), F.col("path").alias("name"), size.alias("amount"))
    many = values.groupBy("pack_id").agg(F.count("*").alias("amount")).where(F.col("amount") > MAX_VALUES)
    return large.unionByName(many.select(F.lit("pack").alias("subject"), F.col("pack_id").alias("name"), "amount"))


def set_problems(packs: list[Pack]) -> list[str]:
    """What keeps packs from being used together: an id twice, or rules of one priority and pattern that name different services."""
    out = [f"id {i} {n} times" for i, n in sorted(Counter(p.id for p in packs).items()) if n > 1]
    named: dict[tuple, set] = {}
    for p in packs:
        for r in p.rules:
            named.setdefault((p.priority, r.get("type", ""), r["target_pattern"]), set()).add(r["service"])
    return out + [f"rules of priority {k[0]} for {k[2]} name {', '.join(sorted(v))}" for k, v in sorted(named.items()) if len(v) > 1]


def check(spark: SparkSession, pack: Pack) -> DataFrame:
    """(test, side, path, target, value): what a pack's own tests miss or find besides; no rows where all hold.

    A test has files (path -> text) and expect, a list of path, target and value; it is exact, so an empty list is a negative one.
    """
    files = [(f"{i}/{path}", text) for i, t in enumerate(pack.tests) for path, text in (t.get("files") or {}).items()]
    want = [(f"{i}/{e['path']}", e["target"], str(e["value"])) for i, t in enumerate(pack.tests) for e in t.get("expect") or ()]
    own = Pack(pack.id, pack.priority, pack.name, pack.files, tuple({**e, "glob": f"*/{e['glob']}"} if e.get("glob") else e for e in pack.extractions))
    got = extract(spark.createDataFrame(files, "path string, text string"), [own]).select("path", "target", "value")
    expected = spark.createDataFrame(want, "path string, target string, value string").distinct()
    both = expected.exceptAll(got).withColumn("side", F.lit("missing")).unionByName(got.exceptAll(expected).withColumn("side", F.lit("unexpected")))
    names = F.create_map(*[F.lit(x) for i, t in enumerate(pack.tests) for x in (str(i), t.get("name", str(i)))]) if pack.tests else F.lit(None)
    at = F.split_part("path", F.lit("/"), F.lit(1))
    return both.select((names[at] if pack.tests else at).alias("test"), "side", F.regexp_replace("path", r"^\d+/", "").alias("path"), "target", "value")


def edge_check(found: DataFrame, expected: DataFrame) -> DataFrame:
    """(side, src, dst, edge_type): edges of a graph test that are missing or unexpected; the expected set is complete."""
    k = ["src", "dst", "edge_type"]
    a, b = found.select(k).distinct(), expected.select(k).distinct()
    return b.exceptAll(a).withColumn("side", F.lit("missing")).unionByName(a.exceptAll(b).withColumn("side", F.lit("unexpected"))).select("side", *k)


def lock(packs: list[Pack]) -> dict[str, str]:
    """The digest of each active pack by its id."""
    return {p.id: digest([p]) for p in packs}


def lock_changes(packs: list[Pack], locked: dict[str, str]) -> dict[str, str]:
    """id -> added, removed or changed against what was locked."""
    now = lock(packs)
    return {i: "added" if i not in locked else "removed" if i not in now else "changed" for i in sorted(now.keys() | locked.keys()) if now.get(i) != locked.get(i)}


def digest(packs: list[Pack]) -> str:
    """Digest of the active set, whatever order it was loaded in."""
    import hashlib

    return hashlib.sha256("\n".join(sorted(repr(p) for p in packs)).encode()).hexdigest()
