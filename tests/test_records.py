"""Nested records, snapshot changes, dangling references: small cases and brute force."""

import json
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from factloom.operators import references, shredding, snapshots
from factloom.operators.references import dangling, found, sorted_array

T0 = datetime(2025, 1, 1)


def shred(spark, docs, table="service_docs"):
    texts = spark.createDataFrame([(table, i, b) for i, b in docs], "table_name string, root_id string, body string")
    nodes = shredding.adjacency(texts, shredding.SPECS, ("id", "name", "status", "from", "to"), wrap={"entities": "details"})
    rows = shredding.records(nodes, pivot={}).select("root_id", "record_path", "record_id", "parent_id").distinct().collect()
    return {tuple(r) for r in rows}


def test_every_shape_of_a_collection_gives_the_same_records(spark):
    want = {("r", "objects.db_queries", "a", "r"), ("r", "objects.db_queries", "b", "r")}
    shapes = [
        [{"id": "a"}, {"id": "b"}],
        {"a": {"kind": "q"}, "b": {"kind": "q"}},
        json.dumps([{"id": "a"}, {"id": "b"}]),
        json.dumps({"a": {"kind": "q"}, "b": {}}),
        [{"id": "a"}, None, {"id": ""}, {"kind": "no key"}, {"id": "b"}, {"id": "b"}],
    ]
    for shape in shapes:
        assert shred(spark, [("r", json.dumps({"objects": {"db_queries": shape}}))]) == want, shape
    assert shred(spark, [("r", json.dumps({"objects": {"db_queries": {"id": "a", "name": "x"}}}))]) == {("r", "objects.db_queries", "a", "r")}


def test_endpoints_fields_responses_and_schemas(spark):
    body = {
        "objects": {
            "http_endpoints": {
                "id": "e",
                "inputs": {
                    "path_params": ["p", {"name": "q", "type": "string"}],
                    "query_params": {"x": "string", "y": {"type": "int"}},
                    "headers": {"name": "h", "required": True},
                    "body": {"schema": {"properties": {"a": {"properties": {"b": {}}}, "l": {"type": "array", "items": {"properties": {"i": {}}}}}}},
                },
                "responses": [{"status": 200}, {"status": "404"}, {"status": 200.0}],
            }
        },
        "flows": {"f": {"nodes": {"n0": {}, "n1": {}}, "edges": {"from": "n0", "to": "n1"}, "data_dependencies": [{"id": "d", "from": {"expression": "x"}}]}},
        "evidence": [{"id": "ev"}],
    }
    e, s = "objects.http_endpoints", "objects.http_endpoints.inputs.body.schema.properties"
    want = {
        ("r", e, "e", "r"), ("r", f"{e}.inputs.path_params", "e/p", "e"), ("r", f"{e}.inputs.path_params", "e/q", "e"),
        ("r", f"{e}.inputs.query_params", "e/x", "e"), ("r", f"{e}.inputs.query_params", "e/y", "e"), ("r", f"{e}.inputs.headers", "e/h", "e"),
        ("r", s, "e/a", "e"), ("r", s, "e/a.b", "e/a"), ("r", s, "e/l", "e"), ("r", s, "e/l.i", "e/l"),
        ("r", f"{e}.responses", "e/200", "e"), ("r", f"{e}.responses", "e/404", "e"),
        ("r", "flows", "f", "r"), ("r", "flows.nodes", "f/n0", "f"), ("r", "flows.nodes", "f/n1", "f"), ("r", "flows.edges", "f/n0->n1", "f"),
        ("r", "flows.data_dependencies", "f/d", "f"), ("r", "evidence", "ev", "r"),
    }
    texts = [json.dumps(body), "﻿" + json.dumps(body), json.dumps(json.dumps(body)), json.dumps(body, indent=2)]
    for t in texts:
        assert shred(spark, [("r", t), ("r", t)]) == want


def test_unreadable_bodies_and_details(spark):
    assert shred(spark, [("a", None), ("b", ""), ("c", " "), ("d", '{"objects": {"db_queries": [{"id": "x"'), ("e", "[1]"), ("f", "null"), (None, "{}")]) == set()
    details = {"request_fields": ["a"], "metadata": {"details": json.dumps({"headers": {"b": "string"}})}, "other": 1}
    assert shred(spark, [("x", json.dumps(details))], "entities") == {
        ("x", "details.request_fields", "x/a", "x"), ("x", "details.metadata.details.headers", "x/b", "x")}
    assert shred(spark, [("deep", "[" * 100_000 + "]" * 100_000)]) == set()
    long = {"objects": {"db_queries": [{"id": f"q{i}"} for i in range(60_000)]}}
    assert len(shred(spark, [("r", json.dumps(long))])) == 60_000


def test_depth_and_wrapping_have_no_limit(spark):
    records = {"objects": {"db_queries": [{"id": "a"}]}}
    for times in (3, 4, 5, 12):
        text = json.dumps(records)
        for _ in range(times):
            text = json.dumps(text)
        assert shred(spark, [("r", text)]) == {("r", "objects.db_queries", "a", "r")}, times
    deep = json.dumps(records)[:-1] + ', "other": ' + "[" * 100_000 + "]" * 100_000 + "}"
    assert shred(spark, [("r", deep)]) == {("r", "objects.db_queries", "a", "r")}
    for n in (63, 64, 65, 6_400):
        schema = '{"items": ' * n + '{"properties": {"leaf": {}}}' + "}" * n
        body = '{"objects": {"http_endpoints": {"id": "e", "inputs": {"body": {"schema": {"properties": {"l": %s}}}}}}}' % schema
        assert {x[2] for x in shred(spark, [("r", body)])} == {"e", "e/l", "e/l.leaf"}, n


def test_deep_reader_agrees_with_the_standard_one():
    rng = random.Random(3)

    def value(depth):
        kind = rng.randrange(9 if depth < 5 else 7)
        if kind == 7:
            return [value(depth + 1) for _ in range(rng.randrange(4))]
        if kind == 8:
            return {rng.choice("abc") * rng.randint(0, 2): value(depth + 1) for _ in range(rng.randrange(4))}
        return [None, True, False, rng.randint(-9, 9), rng.random() * 1e9, "x'é\n\\", ""][kind]

    for _ in range(300):
        v = value(0)
        for indent in (None, 1):
            text = json.dumps(v, indent=indent)
            assert shredding.read_deep(text) == v
            for i in rng.sample(range(len(text)), min(4, len(text))):
                broken = text[:i] + rng.choice("{}[],:") + text[i + rng.randint(0, 1) :]
                try:
                    want = json.loads(broken)
                except ValueError:
                    want = ValueError
                try:
                    got = shredding.read_deep(broken)
                except ValueError:
                    got = ValueError
                assert got == want, broken


def test_nodes_keep_lists_depth_and_roots(spark):
    prop = {"type": "array", "items": {"type": "string", "properties": {"z": {}}}}
    endpoint = {"id": "e", "evidence_refs": ["v1", "v2"], "a": {"b": {"c": {"d": {"x": 1}}}}, "l": [{"m": 1}, [2, 3]], "inputs": {"body": {"schema": {"type": "object", "required": ["p"], "properties": {"p": prop}}}}}
    texts = [("service_docs", "s", json.dumps({"version": 2, "objects": {"http_endpoints": [endpoint]}})), ("entities", "t", json.dumps({"method": "GET", "metadata": {"rev": 7}, "headers": ["h"]}))]
    nodes = shredding.adjacency(spark.createDataFrame(texts, "table_name string, root_id string, body string"), shredding.SPECS, wrap={"entities": "details"})
    rows = nodes.collect()
    got = {(r.root_id, r.record_path.rpartition(".")[2], r.label, r.ordinal, r.scalar) for r in rows if r.kind == "scalar"}
    e = "http_endpoints"
    assert got == {
        ("s", "", "version", 0, "2"), ("s", e, "id", 0, "e"), ("s", e, "evidence_refs", 0, "v1"), ("s", e, "evidence_refs", 1, "v2"), ("s", e, "a.b.c.d.x", 0, "1"), ("s", e, "l.0.m", 0, "1"), ("s", e, "l.1", 0, "2"), ("s", e, "l.1", 1, "3"),
        ("s", e, "inputs.body.schema.type", 0, "object"), ("s", e, "inputs.body.schema.required", 0, "p"), ("s", "properties", "name", 0, "p"), ("s", "properties", "type", 0, "array"), ("s", "properties", "items.type", 0, "string"), ("s", "properties", "name", 0, "z"),
        ("t", "", "method", 0, "GET"), ("t", "", "metadata.rev", 0, "7"), ("t", "headers", "name", 0, "h"),
    }
    assert {(r.root_id, r.label) for r in rows if r.kind == "object" and r.parent == 0} == {("s", ""), ("t", "details")}
    flat = {r.record_id: r.attributes for r in shredding.records(nodes).collect()}
    assert flat["e"]["evidence_refs"] == "v1,v2" and set(flat) == {"e", "e/p", "e/p.z", "t/h"}


FIELD = "project_id string, run_id string, endpoint_id string, service string, location string, name string, type string, required boolean, nullable boolean, ingested_at timestamp, value string"
RUN = "run_id string, project_id string, status string, started_at timestamp"


def test_snapshot_changes_against_brute_force(spark):
    rng = random.Random(4)
    runs = [(f"run{i}", f"p{i % 3}", rng.choice(["succeeded", "completed", "failed", "Failed"]), T0 + timedelta(days=rng.randrange(300), seconds=i)) for i in range(15)]
    fields, latest = [], {}
    for r, p, status, _ in runs:
        for k in rng.sample(range(12), rng.randint(0, 10)):
            for copy in range(rng.choice([1, 1, 2])):
                key = (rng.choice(["s", None]) if k == 11 else "s", f"e{k % 4}", "query", None if k == 5 else f"n{k}")
                v = (rng.choice(["String", "string ", "int", None, ""]), rng.choice([True, False, None]), rng.choice([True, False, None]))
                at = T0 + timedelta(seconds=copy)
                fields.append((p, r, key[1], key[0], key[2], key[3], *v, at, "clash"))
                c = ((v[0] or "").strip().lower(), bool(v[1]), bool(v[2]))
                old = latest.setdefault((p, r), {}).get(key)
                if old is None or (at, c[1], c[2], c[0]) > (old[0], old[1][1], old[1][2], old[1][0]):
                    latest[p, r][key] = (at, c)
    want = set()
    for p in {x[1] for x in runs}:
        good = sorted((x for x in runs if x[1] == p and x[2].lower() != "failed"), key=lambda x: x[3])
        for a, b in zip(good, good[1:]):
            old, new = latest.get((p, a[0]), {}), latest.get((p, b[0]), {})
            for key in {*old, *new}:
                if key not in old or key not in new:
                    want.add((p, a[0], b[0], *key, "added" if key not in old else "removed", ""))
                elif old[key][1] != new[key][1]:
                    names = [n for n, i in (("nullable", 2), ("required", 1), ("type", 0)) if old[key][1][i] != new[key][1][i]]
                    want.add((p, a[0], b[0], *key, "modified", ",".join(names)))
    got = snapshots.contract_changes(spark.createDataFrame(fields, FIELD), spark.createDataFrame(runs, RUN)).drop("before", "after")
    rows = [tuple(r) for r in got.select("project_id", "from_run_id", "to_run_id", "service", "endpoint_id", "location", "name", "change", "changed_fields").collect()]
    assert set(rows) == want and len(rows) == len(want)


def test_snapshots_without_rows(spark):
    runs = spark.createDataFrame([("a", "p", "completed", T0), ("b", "p", None, T0 + timedelta(1))], RUN)
    one = spark.createDataFrame([("p", "a", "e", "s", "query", "n", None, None, None, T0, "")], FIELD)
    assert [r.change for r in snapshots.contract_changes(one, runs).collect()] == ["removed"]
    assert snapshots.contract_changes(one.limit(0), runs).count() == 0
    assert snapshots.contract_changes(one, runs.limit(0)).count() == 0


def test_binary_search_in_both_layouts():
    for keys in ([], ["a"], ["a", "b\0", "c"], ["é", "ß" * 90], sorted(f"k{i:03d}" for i in range(0, 500, 3))):
        arr, width = sorted_array(sorted(keys))
        wanted = ["", "a", "b", "b\0", "z", "é", "k003", "k004", "x" * 300, *keys]
        assert list(found(arr, width, wanted)) == [w in keys for w in wanted]


def test_dangling_with_ranges_salts_and_hot_keys(spark):
    rng = random.Random(2)
    parents = [f"p{i:04d}" for i in range(300)]
    refs = [(f"c{i}", rng.choice(["p0007", "p9999", f"p{rng.randrange(600):04d}"])) for i in range(4000)]
    df = spark.createDataFrame(refs, "child_key string, ref_key string").select(
        F.lit("t").alias("child_table"), F.lit("c").alias("child_column"), "child_key", "ref_key", F.lit(None).cast("string").alias("period"), F.concat(F.lit("x\u0001"), "ref_key").alias("probe"))
    keys = spark.createDataFrame([("x\u0001" + p,) for p in parents * 2], "parent string")
    got = dangling(df, keys, keys_per_range=16, refs_per_task=100)
    assert sorted((r.child_key, r.ref_key) for r in got.collect()) == sorted((c, r) for c, r in refs if r not in parents)
    assert dangling(df, keys.limit(0)).count() == len(refs)
    assert dangling(df.limit(0), keys).count() == 0


def test_project_references(spark):
    con = spark.createDataFrame(
        [("c1", " EXP-1 ", "dep-9", T0), ("c1", " EXP-1 ", "dep-9", T0), ("c2", "dep-1", " ", T0), ("c3", None, "dep-2", None)],
        "connection_id string, from_exposure_id string, to_dependency_id string, created_at timestamp",
    )
    att = spark.createDataFrame([("a1", "JOB-1", T0), ("a2", "job-2", T0)], "attempt_id string, job_id string, started_at timestamp")
    ent = spark.createDataFrame([("exp-1", "exposure", None), ("dep-1", "dependency", None), ("dep-2", "dependency", T0)], "entity_id string, kind string, deleted_at timestamp")
    jobs = spark.createDataFrame([("job-1", None), ("job-2", T0)], "job_id string, deleted_at timestamp")
    got = {tuple(r) for r in references.dangling_references(con, att, ent, jobs).collect()}
    assert got == {
        ("connections", "to_dependency_id", "c1", "dep-9", "2025-01"), ("connections", "from_exposure_id", "c2", "dep-1", "2025-01"),
        ("connections", "to_dependency_id", "c3", "dep-2", None), ("job_attempts", "job_id", "a2", "job-2", "2025-01"),
    }
