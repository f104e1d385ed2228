"""The reference operators on small tables: normalizers, reconciliation, resolution, graphs, packs, sources, queue, streams."""

import json
import os
import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from factloom.api import GraphStore
from factloom.functions import norm as N
from factloom.operators import derive, packs, reconcile, resolve
from factloom.operators import graph as G
from factloom.operators import jobs as J
from factloom.operators import traverse as T
from factloom.operators.predicates import glob_regex
from factloom.sources import code, files, store
from factloom.streaming import jobs as SJ

T0 = datetime(2025, 1, 1)
SMALL = "/root/testdata/sf0.001"


def one(spark, fn, *values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    return [r[0] for r in df.select(fn("v")).collect()]


@pytest.mark.parametrize(
    "fn, cases",
    [
        (N.service_name, {"service.a_b": "a-b", "https://x-y.corp.example/p": "x-y", "z.svc.cluster.local": "z", None: "", " ": ""}),
        (N.queue_key, {"queue:Orders.V1": "ordersv1", "arn:aws:sqs:eu:1:my-q.fifo": "myq_fifo", "https://sqs.x/1/My_Q": "myq", "": ""}),
        (N.queue_topic, {"A-b_c.d.fifo": "abcd"}),
        (N.queue_route, {"A-b.fifo": "ab.fifo", "'q'": "q"}),
        (N.route_path, {"${A:https://h/p}/x?y": "/p/x", "${A}/z": "/z", "https://h": "", "x": "", "/a?b": "/a"}),
        (N.route_normal, {"/A/{id}//b/": "/a/{}/b", "/": "/", "https://h/:x": "/{}", "": ""}),
        (N.route_canonical, {"a/{x}/*/<y>/:z/": "/a/{}/{}/{}/{}", "/": "/", "": ""}),
        (N.operation, {"FindAll": "read", "removeX": "delete", "upsert": "write", "evict": "evict", None: ""}),
        (N.singular, {"orders": "order", "entries": "entry", "status": "status", "addresses": "address", "bus": "bus"}),
        (N.platform_class, {"PostgreSQL": "postgres", "jdbc": "", "OpenSearch": "elasticsearch", "x": "x"}),
        (N.config_profile, {"config/application-prod.yml: a.b": "prod", ".env.default": "", "deploy/stg/values.yaml: x": "stg"}),
        (N.snake, {"HTTPServerName": "http_server_name", "a-b": "a_b"}),
        (N.hostname, {"https://u:p@h.corp.example:80/x": "h", "H.svc.cluster.local:1": "h"}),
        (N.static_suffix, {"{{ .x }}-orders": "orders", "${A}-ab": ""}),
    ],
)
def test_normalizers(spark, fn, cases):
    assert one(spark, fn, *cases) == list(cases.values())


def test_globs():
    import re

    assert re.match(glob_regex("**/*.go"), "a/b/c.go") and re.match(glob_regex("**/*.go"), "c.go") and not re.match(glob_regex("*.go"), "a/c.go")
    assert re.match(glob_regex("a/**"), "a/b/c") and re.match(glob_regex("a?c"), "abc") and not re.match(glob_regex("a?c"), "a/c")
    assert re.match(glob_regex("[a-m]*"), "cart") and not re.match(glob_regex("[a-m]*"), "zoo") and re.match(glob_regex("a[b"), "a[b")


FACT = "entity_id string, project_id string, kind string, type string, name string, service string, platform string, instance string, operation string, operation_kind string, summary string, host string, db_name string, file string, start_line int, end_line int, confidence double, d_method string, d_path string, d_table string, logical_name string, url_template string"


def facts(spark, *rows):
    cols = [c.split()[0] for c in FACT.split(", ")]
    return spark.createDataFrame([tuple({"project_id": "p", "kind": "dependency", "service": "s", **r}.get(c) for c in cols) for r in rows], FACT)


def test_dedupe_fills_gaps_and_is_idempotent(spark):
    f = facts(
        spark,
        dict(entity_id="a", type="db_operation", name="x", d_table="orders", operation_kind="find", platform="jdbc", confidence=0.9),
        dict(entity_id="b", type="db_operation", name="x", d_table="Order", operation_kind="read", host="h", confidence=0.5),
        dict(entity_id="c", type="db_operation", name="x", d_table="order", operation_kind="delete", confidence=None),
    )
    d = {r.entity_id: r for r in reconcile.deduped(reconcile.semantic_key(f), "service", "semantic").collect()}
    assert set(d) == {"a", "c"} and d["a"].host == "h" and d["a"].copies == 2
    e = reconcile.fold_generic_platforms(facts(spark, dict(entity_id="a", type="db_operation", d_table="t", operation_kind="get", platform="jdbc"), dict(entity_id="b", type="db_operation", d_table="t", operation_kind="read", platform="mysql")))
    assert {r.engine for r in e.collect()} == {"mysql"}
    assert reconcile.deduped(reconcile.semantic_key(f.limit(0)), "semantic").count() == 0


def test_schema_names_adopt_only_what_is_certain(spark):
    df = spark.createDataFrame([("g", "a.t"), ("g", "t"), ("g", "x.u"), ("g", "y.u"), ("g", "u"), ("g", "v")], "g string, t string")
    got = {(r.t, r.qualified) for r in reconcile.adopt_schema(df, ["g"], "t").collect()}
    assert ("t", "a.t") in got and ("u", "u") in got and ("v", "v") in got


def test_config_ladder(spark):
    rows = [("k1", "v", ""), ("k1", "v", "qa"), ("k2", "a", ""), ("k2", "p", "prod"), ("k3", "a", ""), ("k3", "b", "qa"), ("k4", "a", "qa"), ("k4", "b", "dev"), ("k5", "x", "qa"), ("k5", "y", "")]
    got = {r.k: (r.value, r.decided_by) for r in reconcile.consensus(spark.createDataFrame(rows, "k string, v string, p string"), ["k"], "v", "p").collect()}
    assert got == {"k1": ("v", "agree"), "k2": ("p", "production"), "k3": ("a", "base"), "k4": (None, "unresolved"), "k5": ("y", "base")}


def test_routes_need_one_owner(spark):
    f = facts(
        spark,
        dict(entity_id="d1", type="outbound_http", name="GET /orders/{id}", service="a"), dict(entity_id="d2", type="outbound_http", name="GET /v1/items", service="a"),
        dict(entity_id="d3", type="outbound_http", name="GET /both", service="a"), dict(entity_id="d4", type="outbound_http", name="GET /health", service="a"), dict(entity_id="d5", type="outbound_http", name="POST /orders/:x", service="a"),
        dict(entity_id="e1", kind="exposure", type="http_route", name="GET /orders/:key", service="b"), dict(entity_id="e2", kind="exposure", type="http_route", name="GET /items", service="b"),
        dict(entity_id="e3", kind="exposure", type="http_route", name="GET /both", service="b"), dict(entity_id="e4", kind="exposure", type="http_route", name="GET /both", service="c"),
        dict(entity_id="e5", kind="exposure", type="http_route", name="GET /health", service="b"), dict(entity_id="e6", kind="exposure", type="http_route", name="GET /orders/{id}", service="a"),
    )
    assert {(r.entity_id, r.to_service, r.tier) for r in resolve.route_matches(f).collect()} == {("d1", "b", "exact"), ("d2", "b", "stripped")}


def test_identity_tiers_and_conflicts(spark):
    deps = spark.createDataFrame(
        [("1", "x", "outbound_http", "order-hub"), ("2", "x", "outbound_http", "https://order-hub.svc.cluster.local/a"), ("3", "x", "outbound_http", "url of billing gate at eu"), ("4", "x", "outbound_rpc", "the billing-gate thing"), ("5", "x", "outbound_http", "abc"), ("6", "order-hub", "outbound_http", "order-hub"), ("7", "x", "outbound_http", "twin-name")],
        "entity_id string, service string, type string, target string",
    )
    ids = spark.createDataFrame([("order-hub", "order-hub"), ("billing gate", "billing"), ("abc", "abcd"), ("twin-name", "t1"), ("twin-name", "t2")], "value string, owner string")
    got = {r.entity_id: (r.to_service, r.confidence, r.conflict) for r in resolve.identity_matches(deps, ids).collect()}
    assert got["1"] == ("order-hub", 0.95, False) and got["2"][0] == "order-hub" and got["3"] == ("billing", 0.75, False)
    assert "4" not in got and "6" not in got and got["7"][2] is True


def test_rules_prefer_priority_and_report_conflicts(spark):
    deps = spark.createDataFrame([("1", "x", "outbound_http", "a-one.h"), ("2", "x", "outbound_http", "b-two.h"), ("3", "x", "db_operation", "a-one.h")], "entity_id string, service string, type string, target string")
    svc = spark.createDataFrame([("a",), ("b",), ("z",)], "service string")
    rules = [("low", "^outbound", r"^(\w)-.*", "$1", 1, 0.5), ("hi1", "^outbound", r"^a-.*", "z", 9, 0.9), ("hi2", "^outbound", r"^b-.*", "z", 9, 0.9), ("hi3", "^outbound", r"^(b)-.*", "$1", 9, 0.9)]
    got = {r.entity_id: (r.to_service, r.conflict) for r in resolve.rule_matches(deps, rules, svc).collect()}
    assert got == {"1": ("z", False), "2": ("b", True)}


def test_positions_take_the_smallest_range(spark):
    pts = spark.createDataFrame([("p1", "f", 10), ("p2", "f", 500), ("p3", "g", 10), ("p4", "f", 21)], "point_id string, file string, line int")
    rng = spark.createDataFrame([("big", "f", 1, 400), ("small", "f", 8, 20), ("wide", "f", 400, 900)], "range_id string, file string, lo int, hi int")
    assert {r.point_id: r.range_id for r in resolve.containing(pts, rng, bucket=16).collect()} == {"p1": "small", "p2": "wide", "p4": "small"}


def edges_of(spark, *pairs):
    return spark.createDataFrame([(a, b) for a, b in pairs], "src string, dst string")


def test_shortest_paths_ties_bounds_and_cycles(spark):
    e = edges_of(spark, ("a", "c"), ("a", "b"), ("b", "d"), ("c", "d"), ("d", "a"), ("d", "e"), ("x", "y"))
    t = spark.createDataFrame([("d",), ("e",), ("y",), ("a",)], "node string")
    got = {r.target: (r.status, r.path) for r in T.shortest_path(e, "a", t, 6).collect()}
    assert got == {"d": ("found", "a>b>d"), "e": ("found", "a>b>d>e"), "y": ("not_found", got["y"][1]), "a": ("found", "a")}
    cut = {r.target: r.status for r in T.shortest_path(e, "a", t, 1).collect()}
    assert cut["d"] == "limited" and cut["y"] == "limited"


def test_impact_grows_with_depth_and_knows_directions(spark):
    typed = spark.createDataFrame([("service:a", "service:b", "http"), ("service:b", "queue:q", "queue_publish"), ("queue:q", "service:c", "queue_consume"), ("service:a", "x", "external")], "src string, dst string, edge_type string")
    i = G.impact_edges(typed)
    near = {r.node for r in T.blast_radius(i, "service:b", 1).collect()}
    far = {(r.node, r.is_async) for r in T.blast_radius(i, "service:b", 5).collect()}
    assert near == {"service:a", "queue:q"} and far == {("service:a", False), ("queue:q", True), ("service:c", True)}


def test_whole_impact_reaches_beyond_two_hops_and_tells_bounds(spark, monkeypatch):
    from factloom.plans import graphs

    chain = spark.createDataFrame([(f"service:{i}", f"service:{i + 1}", "http") for i in range(9)], "a string, b string, edge_type string")
    monkeypatch.setattr(graphs, "impact", lambda spark, d: chain)
    monkeypatch.setattr(graphs.B, "services", lambda spark, d: spark.createDataFrame([(i, "t") for i in range(10)], "service_id int, team string"))
    got = graphs.g10_blast_radius(spark, "").collect()
    assert {r.node: r.depth for r in got} == {f"service:{i}": i for i in range(1, 7)} and all(r.bounded for r in got)
    assert [tuple(r) for r in graphs.g23_company_impact(spark, "").collect()] == [("t", 1, 7, False)]
    assert not any(r.bounded for r in T.blast_radius(chain, "service:0", 9).collect())


def test_paths_keep_diamonds_and_end_at_cycles(spark):
    e = edges_of(spark, ("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "a"))
    entries = spark.createDataFrame([("a",)], "entry string")
    assert sorted("".join(r.path) for r in T.call_walk(e, entries, 5, 100).collect()) == ["ab", "abd", "ac", "acd"]


def test_reach_is_the_same_by_copies_and_by_joins(spark):
    rng = random.Random(11)
    pairs = [(f"n{rng.randrange(25)}", f"n{rng.randrange(25)}") for _ in range(60)] + [("n1", "n1"), ("n2", None)]
    e, roots = edges_of(spark, *pairs), spark.createDataFrame([("n1",), ("n2",), ("n1",), ("none",), (None,)], "root string")
    for depth, nodes in ((1, None), (2, None), (9, None), (9, 6)):
        one, two = ({tuple(map(str, r)) for r in T.levels(e, roots, depth, nodes, most_edges=m).collect()} for m in (1_000, 0))
        assert one == two and len(one) > 3, (depth, nodes)
    assert T.levels(e.limit(0), roots, 3).count() == 3 and T.levels(e, roots.limit(0), 3).count() == 0


def test_layout_keeps_all_edges_that_close_no_cycle(spark):
    rng = random.Random(5)

    def reaches(kept, a, b):
        seen, stack = {a}, [a]
        while stack:
            x = stack.pop()
            for p, q in kept:
                if p == x and q not in seen:
                    seen.add(q)
                    stack.append(q)
        return b in seen

    for _ in range(60):
        pairs = sorted({(str(rng.randrange(9)), str(rng.randrange(9))) for _ in range(rng.randint(0, 25))})
        rng.shuffle(pairs)
        kept = []
        for a, b in pairs:
            if a != b and not reaches(kept, b, a):
                kept.append((a, b))
        got, up = T.acyclic(pairs)
        assert got == kept and all(up.index(a) < up.index(b) for a, b in kept)
    e = edges_of(spark, ("2", "1"), ("1", "10"), ("10", "2"), ("2", "3"), ("9", "3"), ("x", "1"))
    nodes = spark.createDataFrame([("1",), ("2",), ("3",), ("9",), ("10",), ("alone",)], "node string")
    got = {r.node: (r["rank"], r.place) for r in T.layout(e, nodes, ["src"]).collect()}
    # in order of the sources: 1 -> 10, 10 -> 2, then 2 -> 1 closes a cycle
    assert {k: v[0] for k, v in got.items()} == {"1": 0, "10": 1, "2": 2, "3": 3, "9": 0, "alone": 0} and sorted(v for v in got.values() if v[0] == 0) == [(0, 0), (0, 1), (0, 2)]
    assert T.layout(e.limit(0), nodes.limit(0), ["src"]).count() == 0


def test_cycles_are_found_in_a_large_graph_in_time():
    rng = random.Random(8)
    for nodes, many, in_order in ((70, 400, False), (200, 900, True)):  # several blocks, against a search for each edge
        pairs = list({(str(rng.randrange(nodes)), str(rng.randrange(nodes))) for _ in range(many)})
        pairs.sort(key=None if in_order else lambda _: rng.random())
        after, kept = {}, []
        for a, b in pairs:
            seen, stack = {b}, [b]
            while stack:
                new = after.get(stack.pop(), set()) - seen
                seen |= new
                stack += new
            if a not in seen:
                after.setdefault(a, set()).add(b)
                kept.append((a, b))
        got, up = T.acyclic(pairs)
        place = {x: i for i, x in enumerate(up)}
        assert got == kept and all(place[a] < place[b] for a, b in kept) and len(place) == len({x for p in pairs for x in p})
    pairs = sorted({(str(rng.randrange(4000)), str(rng.randrange(4000))) for _ in range(24_000)})
    began = time.process_time()
    got, up = T.acyclic(pairs)
    assert time.process_time() - began < 10 and len(up) == 4000 and 12_000 < len(got) < len(pairs)


def test_connections_are_derived_from_calls_and_places(spark, monkeypatch):
    from factloom.plans import graphs

    step = "connection_id string, step_no int, from_symbol string, to_symbol string"
    steps = [("c1", 1, "A.a", "B.b"), ("c1", 2, "B.b", "C.c"), ("c2", 1, "B.b", "D.d"), ("c3", 1, "T.t", "C.c"), ("c4", 1, "A.a", "A.x"), ("c5", 1, "B.b", "D.d"), ("c6", None, None, None)]
    links = [("c1", "e1", "d1"), ("c2", "e2", "d2"), ("c3", "e3", "d1"), ("c4", "e1", "d4"), ("c5", "e2", "d5"), ("c6", None, "d1")]
    facts = [("e1", "exposure", "a.go", 1, 9, 0.9), ("e2", "exposure", None, None, None, None), ("e3", "exposure", "a_test.go", 1, 9, 0.9), ("d1", "dependency", "b.go", 5, 5, 0.9), ("d2", "dependency", None, None, None, 0.9), ("d3", "dependency", "a.go", 4, 4, 0.9), ("d4", "dependency", "c.yml", 1, 1, 0.9), ("d5", "dependency", "z.go", 1, 1, 0.9)]
    monkeypatch.setattr(graphs, "_steps", lambda spark, d: spark.createDataFrame(steps, step))
    monkeypatch.setattr(graphs.B, "links", lambda spark, d: spark.createDataFrame(links, "connection_id string, src string, dst string"))
    monkeypatch.setattr(graphs.B, "facts", lambda spark, d: spark.createDataFrame(facts, "entity_id string, kind string, file string, start_line int, end_line int, confidence double"))
    got = {tuple(r) for r in graphs.g17_connection_derivation(spark, "").collect()}
    assert got == {
        ("e1", "C.c", "d1", 1, "call_path", 2, 0.94), ("e1", "D.d", "d2", 2, "call_path", 2, 0.94), ("e2", "C.c", "d1", 1, "call_path", 1, 0.98), ("e2", "D.d", "d2", 2, "call_path", 1, 0.98), ("e1", None, "d3", 1, "containment", 0, 0.98),
    }


def test_hops_are_the_same_by_copies_and_by_joins(spark):
    rng = random.Random(12)
    pairs = [(f"n{rng.randrange(25)}", f"n{rng.randrange(25)}") for _ in range(50)] + [("n1", "n1"), ("n2", None)]
    e = edges_of(spark, *pairs)
    starts = [("w1", "n1", "a"), ("w2", "n1", "a"), ("w3", "n7", "b"), ("w4", "none", "a"), ("w5", None, "a"), ("w3", "n9", "c")]
    ends = [(f"n{i}", "abc"[i % 3], i, None) for i in range(20)] + [("elsewhere", "b", 99, "x")]
    s, t = spark.createDataFrame(starts, "who string, root string, owner string"), spark.createDataFrame(ends, "node string, owner string, number int, note string")
    for depth in (1, 2, 15):
        want = []
        for who, root, owner in starts:
            level, front = {root: 0}, {root}
            for n in range(1, depth + 1):
                front = {b for a, b in pairs if a in front and b is not None and b not in level}
                level |= dict.fromkeys(front, n)
            want += [(who, level[x], x, number, note) for x, o, number, note in ends if level.get(x) and o != owner]
        one, two = (sorted(tuple(map(str, r)) for r in T.hops(e, s, t, depth, most_edges=m).collect()) for m in (1_000, 0))
        assert want and one == two == sorted(tuple(map(str, r)) for r in want), depth
    assert T.hops(e.limit(0), s, t, 3).count() == T.hops(e, s.limit(0), t, 3).count() == T.hops(e, s, t.limit(0), 3).count() == 0


def test_what_is_reached_is_neither_joined_nor_sent(spark):
    from factloom.plans import graphs

    plan = graphs.g17_connection_derivation(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = [len(x) - len(x.lstrip(" :+-")) for x in plan]
    walk = next(i for i, x in enumerate(plan) if "MapInArrow" in x)
    above = [x for i, x in enumerate(plan[:walk]) if depth[i] < min(depth[i + 1 : walk + 1])]
    assert above and not any("Join" in x or "Aggregate" in x or "Repartition" in x for x in above)


def test_flows_in_every_shape_are_projected(spark, monkeypatch):
    from factloom.plans import graphs

    a, b, c = ({"id": k, "role": r, "ref": x} for k, r, x in (("n0", "entrypoint", "in"), ("n1", "call", "mid"), ("n2", "call", "out")))
    bare = lambda *ns: {n["id"]: {k: v for k, v in n.items() if k != "id"} for n in ns}
    shapes = [
        [{"id": "f", "nodes": [a, b, c]}], {"id": "f", "nodes": [a, b, c]}, {"f": {"nodes": bare(a, b, c)}}, [{"id": "f", "nodes": bare(a, b, c)}],
        json.dumps([{"id": "f", "nodes": json.dumps([a, b, c])}]), [{"f": {"nodes": [a, b, c]}}],
    ]
    bodies = [json.dumps({"flows": x}) for x in shapes]
    bodies += [json.dumps(bodies[0]), "\ufeff" + bodies[0]]
    docs = [(i, x) for i, x in enumerate(bodies)] + [(90, json.dumps({"flows": {"id": "f", "nodes": a}})), (91, json.dumps({"flows": {"nodes": [{"role": "call", "ref": "x"}]}})), (92, "{"), (93, None)]
    monkeypatch.setattr(graphs, "table", lambda spark, d, name: spark.createDataFrame(docs, "service_doc_id int, body string"))
    got = {tuple(r) for r in graphs.g25_flow_projection(spark, "").collect()}
    assert got == {(str(i), "f", "in", "out") for i in range(len(bodies))} | {("90", "f", "in", None), ("91", None, None, "x")}


def walked(pairs, entries, depth, total, per_symbol=None):
    """A queue, as the reference walks; per entry its paths and whether it has more."""
    adj, out = {}, {}
    for a, b in sorted(set(pairs)):
        adj.setdefault(a, []).append(b)
    for entry_ in entries:
        queue, paths, kept, more = [(entry_,)], [], {}, False
        while queue:
            p = queue.pop(0)
            for b in (x for x in adj.get(p[-1], ()) if x not in p):
                if len(p) > depth or len(paths) >= total or per_symbol and kept.get(b, 0) >= per_symbol:
                    more = True
                    continue
                kept[b] = kept.get(b, 0) + 1
                paths.append(p + (b,))
                queue.append(p + (b,))
        out |= {x: more for x in paths}
    return out


def test_call_walk_goes_deep_and_tells_truncation(spark):
    rng = random.Random(3)
    pairs = [(f"n{i:02d}", f"n{i + 1:02d}") for i in range(18)] + [(f"n{rng.randrange(18):02d}", f"n{rng.randrange(18):02d}") for _ in range(6)] + [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")]
    e, entries = edges_of(spark, *pairs), spark.createDataFrame([("n00",), ("n09",), ("a",), ("n18",)], "entry string")
    for bounds in ((15, 2000), (15, 7), (25, 1000, 1)):
        got, joined = ({tuple(r.path): r.truncated for r in T.call_walk(e, entries, *bounds, most_edges=m).collect()} for m in (1_000, 0))
        assert got == joined == walked(pairs, ["n00", "n09", "a", "n18"], *bounds), bounds
    assert max(len(p) for p in walked(pairs, ["n00"], 15, 2000)) == 16


def test_packs(spark, tmp_path):
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "pack.yaml").write_text(json.dumps({"id": "one", "priority": 5, "applies_to": {"has_file": ["**/*.json"]}, "extractions": [{"strategy": "field_path", "glob": "**/*.json", "path": "items.*.name", "target": "name"}, {"strategy": "regex", "pattern": "team=(\\w+)", "target": "owner"}]}))
    (tmp_path / "pack.yaml").write_text("id: Bad Id\n")
    loaded = packs.load(str(tmp_path))
    assert [p.id for p in loaded] == ["one"] and [p.id for p in packs.with_built_in(loaded, [packs.Pack("two"), packs.Pack("one")])] == ["one", "two"]
    assert packs.parse({"id": "x", "extractions": [{"strategy": "code"}]}).problems
    f = spark.createDataFrame([("a/x.json", '{"items": [{"name": "n1"}, {"name": "n2"}, {}]}', "s"), ("r.txt", "team=core team=core", "s"), ("z", None, "t")], "path string, text string, service string")
    got = {(r.path, r.target, r.value) for r in packs.extract(f, loaded).collect()}
    assert got == {("a/x.json", "name", "n1"), ("a/x.json", "name", "n2"), ("r.txt", "owner", "core")}
    assert {(r.service, r.pack_id) for r in packs.applicable(f, loaded).collect()} == {("s", "one")}
    ids = {(r.path, r.target): (r.value, r.conflict) for r in packs.identity(packs.extract(f, loaded), loaded).collect()}
    assert ids["a/x.json", "name"] == (None, True) and ids["r.txt", "owner"] == ("core", False)
    assert packs.digest(loaded) == packs.digest(list(reversed(loaded)))


def test_pack_tests_limits_sets_and_locks(spark):
    doc = {
        "id": "tickets", "extractions": [{"strategy": "regex", "pattern": r"OPS-\d+", "target": "ticket", "glob": "**/*.md"}, {"strategy": "field_path", "path": "a.*.n", "target": "name", "glob": "*.json"}],
        "tests": [
            {"name": "one", "files": {"x/a.md": "see OPS-1 and OPS-2", "b.json": '{"a": [{"n": "q"}]}', "c.txt": "OPS-3"}, "expect": [{"path": "x/a.md", "target": "ticket", "value": "OPS-1"}, {"path": "b.json", "target": "name", "value": "q"}, {"path": "b.json", "target": "name", "value": "z"}]},
            {"name": "none", "files": {"a.md": "nothing"}, "expect": []},
        ],
    }
    pack = packs.parse(doc)
    assert {tuple(r) for r in packs.check(spark, pack).collect()} == {("one", "unexpected", "x/a.md", "ticket", "OPS-2"), ("one", "missing", "b.json", "name", "z")}
    assert packs.check(spark, packs.parse({"id": "x"})).count() == 0
    files = spark.createDataFrame([("big", "x" * (packs.MAX_FILE + 1)), ("ok", "x" * packs.MAX_FILE)], "path string, text string")
    values = spark.range(packs.MAX_VALUES + 1).select(F.lit("p").alias("pack_id")).union(spark.range(packs.MAX_VALUES).select(F.lit("q")))
    assert {tuple(r) for r in packs.limits(files, values).collect()} == {("file", "big", packs.MAX_FILE + 1), ("pack", "p", packs.MAX_VALUES + 1)}
    rule = lambda i, service: packs.parse({"id": i, "resolution": [{"target_pattern": "^a", "service": service}]})
    assert packs.set_problems([rule("a", "x"), rule("b", "x")]) == [] and len(packs.set_problems([rule("a", "x"), rule("a", "y")])) == 2
    locked = packs.lock([rule("a", "x"), rule("b", "x")])
    assert packs.lock_changes([rule("a", "x"), rule("b", "y"), rule("c", "x")], locked) == {"b": "changed", "c": "added"} and packs.lock_changes([], locked) == {"a": "removed", "b": "removed"}
    e = spark.createDataFrame([("a", "b", "http"), ("a", "c", "http")], "src string, dst string, edge_type string")
    assert packs.edge_check(e, e).count() == 0 and [r.side for r in packs.edge_check(e.limit(1), e).collect()] == ["missing"]


def test_symbol_indexes_are_read_from_their_wire_form(spark, tmp_path):
    from factloom.sources import scip

    def varint(n):
        out = b""
        while n > 0x7F:
            out, n = out + bytes([n & 0x7F | 0x80]), n >> 7
        return out + bytes([n])

    def part(number, v):
        return varint(number << 3) + varint(v) if isinstance(v, int) else varint(number << 3 | 2) + varint(len(v)) + v

    occurrence = lambda at, symbol, role: part(2, part(1, b"".join(map(varint, at))) + part(2, symbol.encode()) + part(3, role) + part(9, 7))
    info = part(3, part(1, b"go Impl#") + part(4, part(1, b"go Iface#") + part(3, 1)) + part(4, part(1, b"go Other#") + part(2, 1)) + part(6, "\u00e9".encode()))
    doc = part(1, b"a/b.go") + part(4, b"Go") + occurrence([3, 5, 9], "go Impl#", 1) + occurrence([300, 1, 301, 2], "go Impl#", 8) + occurrence([1, 2, 3], "local 4", 0) + info
    index = part(1, b"meta") + part(2, doc)
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "i.scip").write_bytes(index + part(2, doc)[:-9])  # the second document breaks off
    (tmp_path / "empty.scip").write_bytes(b"")
    (tmp_path / "no.txt").write_bytes(index)
    rows = scip.read_index(spark, str(tmp_path))
    got = {(r.symbol, r.start_line, r.start_char, r.end_line, r.end_char, r.is_definition) for r in rows.where("row_kind = 'occurrence'").collect()}
    assert got == {("go Impl#", 3, 5, 3, 9, True), ("go Impl#", 300, 1, 301, 2, False), ("a/b.go#local 4", 1, 2, 1, 3, False)}
    assert [tuple(r) for r in scip.definitions(rows).collect()] == [("go Impl#", "a/b.go", 3, 5)] and [tuple(r) for r in scip.implementations(rows).collect()] == [("go Iface#", "go Impl#")]
    at = spark.createDataFrame([(1, "a/b.go", 300), (2, "a/b.go", 4)], "position_id int, document string, line int")
    assert [tuple(r) for r in scip.symbol_at(rows, at).collect()] == [(1, "go Impl#", False)]
    assert list(scip.rows("p", b"\xff\xff\xff")) == [] and list(scip.rows("p", None)) == []


def test_repository_scan_and_parsers(spark, tmp_path):
    tree = {
        "src/main.go": "package main\n\nfunc main() {}\n", "node_modules/x.js": "x", "src/main_test.go": "t", "go.mod": "module x\n\ngo 1.22\n",
        "app.yaml": "a:\n  b: 1\n  c: [x, y]\n---\nspring:\n  profiles: prod\n  url: u\n", "bad.yaml": "a: [1\n", "x.env": "export K=v\n# c\nJ: w\n", "c.json": '{"x": {"y": null}}', "t.toml": '[a]\nb = "c"\n',
        "m.tf": 'resource "aws_sns_topic" "t1" {\n  name = "orders"\n}\nresource "aws_sqs_queue" "q1" {\n  name = "jobs"\n}\nresource "aws_sns_topic_subscription" "s" {\n  topic_arn = aws_sns_topic.t1.arn\n  endpoint = aws_sqs_queue.q1.arn\n}\n',
        "api.yaml": "openapi: 3.0.1\npaths:\n  /o/{id}:\n    post:\n      parameters:\n        - {in: path, name: id, required: true, schema: {type: string}}\n      requestBody:\n        content:\n          application/json:\n            schema: {$ref: '#/components/schemas/O'}\ncomponents:\n  schemas:\n    O:\n      required: [a]\n      properties:\n        a: {type: string}\n        kids: {type: array, items: {$ref: '#/components/schemas/O'}}\n",
    }
    for p, t in tree.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(t)
    f = files.scan(spark, str(tmp_path))
    assert {r.path for r in f.collect()} == set(tree) - {"node_modules/x.js", "src/main_test.go"}
    got = {(r.path, r.key): (r.value, r.line, r.profile) for r in files.config_entries(f).collect()}
    assert got["app.yaml", "a.b"] == ("1", 2, "") and got["app.yaml", "a.c[1]"][0] == "y" and got["app.yaml", "spring.url"] == ("u", 7, "prod")
    assert got["x.env", "K"][0] == "v" and got["x.env", "J"][0] == "w" and got["c.json", "x.y"][0] == "" and got["t.toml", "a.b"][0] == "c"
    assert ("m.tf", "resource.aws_sqs_queue.q1.name") in got and not any(p == "bad.yaml" for p, _ in got)
    assert [(r.topic, r.queue) for r in files.terraform_subscriptions(f).collect()] == [("orders", "jobs")]
    api = {(r.location, r.name, r.required) for r in files.openapi_fields(f).collect()}
    assert api == {("path", "id", True), ("body", "a", True), ("body", "kids", False)}
    assert {r.language: r.loc for r in files.metrics(f).collect()}["Go"] == 2
    assert {(r.language, r.version) for r in files.markers(f).collect()} == {("Go", "1.22")}


def test_symbols_calls_and_imports(spark):
    src = {
        "a.py": ("Python", "import os.path as p\nfrom flask import Flask\n\nclass A:\n    @app.get('/x/{id}')\n    def f(self):\n        return self.repo.find(1)\n\nprint(A())\n"),
        "bad.py": ("Python", "def (:"),
        "b.go": ("Go", "func (s *Store) Get(ctx C) error {\n\treturn s.repo.Find(ctx)\n}\n"),
        "C.java": ("Java", "public class C {\n  public String m(int a) {\n    return this.repo.load(a);\n  }\n}\n"),
        "n": (None, None),
    }
    df = spark.createDataFrame([(p, *v) for p, v in src.items()], "path string, language string, text string")
    rows = code.parsed(df)
    got = {(r.path, r.row_kind, r.name, r.target) for r in rows.collect()}
    assert {("a.py", "symbol", "A.f", "function"), ("a.py", "call", "A.f", "self.repo.find"), ("a.py", "call", "", "print"), ("a.py", "import", "p", "os.path"), ("a.py", "import", "Flask", "flask.Flask"), ("b.go", "call", "Store.Get", "s.repo.Find"), ("C.java", "symbol", "C.m", "function"), ("C.java", "call", "C.m", "this.repo.load")} <= got
    assert not any(p in ("bad.py", "n") for p, *_ in got)
    assert [(r.method, r.route, r.handler) for r in code.python_routes(rows).collect()] == [("GET", "/x/{id}", "A.f")]


def test_documents_runs_and_catalog(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"schema": "x.service.v1", "service": {"name": "s"}}))
    (tmp_path / "b.json").write_text(json.dumps({"schema": "other"}))
    assert [r.service for r in store.read_documents(spark, str(tmp_path)).collect()] == ["s"]
    os.makedirs(tmp_path / "run" / "exposures")
    (tmp_path / "run" / "exposures" / "http_route.json").write_text('[{"id": 1}, {"id": 2}]')
    assert {(r.kind, r.type) for r in store.read_run_dir(spark, str(tmp_path / "run")).collect()} == {("exposures", "http_route")}
    runs = spark.createDataFrame([("r1", "p", "succeeded", T0), ("r2", "p", "failed", T0 + timedelta(1)), ("r0", "p", "completed", T0)], "run_id string, project_id string, status string, finished_at timestamp")
    rows = spark.createDataFrame([("p", "r0", 0), ("p", "r1", 1), ("p", "r2", 2)], "project_id string, run_id string, v int")
    assert [r.v for r in store.load_snapshot(rows, runs).collect()] == [1] and store.load_snapshot(rows, runs, "r2").count() == 0
    out = str(tmp_path / "snap")
    store.write_snapshot(rows.where("run_id = 'r1'"), out)
    with pytest.raises(FileExistsError):
        store.write_snapshot(rows.where("run_id = 'r1'"), out)
    assert store.same_rows(spark.read.schema(rows.schema).parquet(out), rows.where("run_id = 'r1'")) and not store.same_rows(rows, rows.union(rows))
    cat = spark.createDataFrame([("k1", "manual", "x", None), ("k2", "automation", "y", None), ("k3", "automation", "z", "t")], "k string, owner string, a string, b string")
    new = spark.createDataFrame([("k1", "n", "m"), ("k2", "n", None), ("k4", "q", None)], "k string, a string, b string")
    got = {r.k: (r.a, r.b, r.outcome) for r in store.catalog_import(cat, new, "k", ["a", "b"]).collect()}
    assert got == {"k1": ("x", "m", "manual"), "k2": ("n", None, "updated"), "k3": ("z", "t", "kept"), "k4": ("q", None, "added")}


def test_derived_facts(spark):
    sites = spark.createDataFrame([(1, '@GetMapping("/a/{b}")'), (2, "select x, y from orders where 1"), (3, 'cache.get("user:" + id)'), (4, None), (5, 'cron: "0 3 * * *"')], "k int, snippet string")
    assert {(r.k, r.fact_type, r.name) for r in derive.call_facts(sites, ["k"]).collect()} == {(1, "http_route", "/a/{b}"), (2, "db_operation", "orders"), (3, "cache_operation", "user"), (5, "scheduled_job", "0 3 * * *")}
    assert one(spark, lambda c: derive.looks_like_cron(F.col(c)), "0 3 * * *", "hello") == [True, False]


SOURCE = [
    ('@PostMapping(value = "/a/{b}")\npublic X f() {}\n@GetMapping("/c")', {("http_route", "spring", "/a/{b}", "post"), ("http_route", "spring", "/c", "get")}),
    ('@Path("/r")', {("http_route", "jax-rs", "/r", "")}),
    ("app.get('/u/:id', h); router.delete(`/u/:id`, h)", {("http_route", "express", "/u/:id", "get"), ("http_route", "express", "/u/:id", "delete")}),
    ("@Patch('x')", {("http_route", "nestjs", "x", "patch")}),
    ('@app.get("/i/{n}")\nasync def f(): ...', {("http_route", "fastapi", "/i/{n}", "get")}),
    ('@bp.route("/j", methods=["POST"])\n@bp.route("/k")', {("http_route", "flask", "/j", "post"), ("http_route", "flask", "/k", "")}),
    ("path('users/<int:pk>/', v.as_view()),", {("http_route", "django", "users/<int:pk>/", "")}),
    ('http.HandleFunc("GET /p", h); http.Handle("/q", h)', {("http_route", "net/http", "/p", "get"), ("http_route", "net/http", "/q", "")}),
    ('router.HandleFunc("/v", h.x).Methods("PUT")\nrouter.Handle("/w", h)', {("http_route", "gorilla", "/v", "put"), ("http_route", "gorilla", "/w", "")}),
    ('r.GET("/g", h)\napi.Post("/h", h)', {("http_route", "gin", "/g", "get"), ("http_route", "chi", "/h", "post")}),
    ("get '/rails', to: 'x#y'", {("http_route", "rails", "/rails", "get")}),
    ('[HttpPut("z/{id}")] app.MapGet("/m", () => 1);', {("http_route", "asp.net", "z/{id}", "put"), ("http_route", "asp.net", "/m", "get")}),
    ('q := "SELECT a FROM t1 JOIN u"; db.Exec("update t2 set x = 1"); db.Exec(`delete from s.t3 where 1`)', {("db_operation", "sql", "t1", "select"), ("db_operation", "sql", "t2", "update"), ("db_operation", "sql", "s.t3", "delete")}),
    ("orderRepository.findByName(n)", {("db_operation", "jpa", "order", "findbyname")}),
    ("session.query(User).filter(1); Order.objects.filter(x=1)", {("db_operation", "sqlalchemy", "User", "query"), ("db_operation", "django-orm", "Order", "filter")}),
    ("await prisma.invoice.create({}); Cart.findAll()", {("db_operation", "prisma", "invoice", "create"), ("db_operation", "sequelize", "Cart", "findall")}),
    ("db.WithContext(ctx).Model(&Parcel{}).Find(&x)", {("db_operation", "gorm", "Parcel", "")}),
    ('producer.send({ topic: "t" }); kafkaTemplate.send("u", v)', {("queue_publish", "kafka", "t", "send"), ("queue_publish", "kafka", "u", "send")}),
    ("sqs.send_message(QueueUrl='q1', MessageBody=b)", {("queue_publish", "sqs", "q1", "")}),
    ('@KafkaListener(groupId = "g", topics = "in")\n@RabbitListener(queues = "rq")', {("queue_consumer", "kafka", "in", ""), ("queue_consumer", "rabbitmq", "rq", "")}),
    ("axios.post('/x', b); fetch(`/y`); requests.get('http://h/z')", {("outbound_http", "axios", "/x", "post"), ("outbound_http", "fetch", "/y", ""), ("outbound_http", "requests", "http://h/z", "get"), ("outbound_http", "url-literal", "http://h", "")}),
    ('http.NewRequestWithContext(ctx, "PUT", "/n", nil)', {("outbound_http", "net/http", "/n", "put")}),
    ("grpc.insecure_channel('h:1'); grpc.Dial(\"k:2\")", {("outbound_rpc", "grpc", "h:1", ""), ("outbound_rpc", "grpc", "k:2", "")}),
    ("redis.hget('user:1')", {("cache_operation", "redis", "user", "hget")}),
    ("s3.put_object(Bucket='b', Key=k)", {("object_storage", "s3", "b", "put_object")}),
    ("subprocess.run(['ls'])", {("command_exec", "exec", "ls", "")}),
    ('@Scheduled(fixedRate = 1, cron = "0 * * * *")', {("scheduled_job", "cron", "0 * * * *", "")}),
    ('&cobra.Command{Use: "sync", Short: "x"}', {("cli_command", "cli", "sync", "")}),
    ("x = compute(y)  # nothing to see; select the best from all", set()),
]


def test_detectors_read_every_hit_of_each_framework(spark):
    sites = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(SOURCE)], "k int, snippet string")
    got = {}
    for r in derive.call_facts(sites, ["k"]).collect():
        got.setdefault(r.k, set()).add((r.fact_type, r.framework, r.name, r.detail))
    for i, (text, want) in enumerate(SOURCE):
        assert got.get(i, set()) == want, text
    assert derive.call_facts(sites.limit(0), ["k"]).count() == 0


def test_contract_fields_from_documents_and_details(spark, monkeypatch):
    from factloom.plans import extras

    endpoint = {"id": "ep", "inputs": {"path_params": ["p"], "headers": {"h": "string"}, "body": {"schema": {"properties": {"a": {"type": "object", "properties": {"b": {"type": "int", "required": True}}}}}}}, "responses": [{"status": 200}]}
    docs = spark.createDataFrame([(1, json.dumps({"objects": {"http_endpoints": [endpoint]}})), (2, None)], "service_doc_id long, body string")
    ents = spark.createDataFrame([("x", "exposure", '{"query_params": [{"name": "q", "nullable": true}]}'), ("y", "dependency", '{"headers": ["no"]}'), ("z", "exposure", None)], "entity_id string, kind string, details string")
    monkeypatch.setattr(extras, "table", lambda spark, d, name: {"service_docs": docs, "entities": ents}[name])
    assert {tuple(r) for r in extras.g22_contract_fields(spark, "").collect()} == {
        ("ep", "path", "p", "", False, False, "route"), ("ep", "header", "h", "string", False, False, "static"), ("ep", "body", "a", "object", False, False, "schema"), ("ep", "body", "a.b", "int", True, False, "schema"), ("x", "query", "q", "", False, True, "static"),
    }


def test_enrichments_of_handlers(spark):
    sites = spark.createDataFrame([(1, '@PreAuthorize("x")\nf(@PathVariable("id") Long id, @RequestParam(name = "q") String q, @RequestHeader("X-T") String t)'), (2, 'req.getHeader("Authorization")'), (3, "@UseGuards(A) f(@Query('page') p, @Body('name') n)"), (4, None)], "k int, snippet string")
    got = {tuple(r) for r in derive.enrichments(sites, ["k"]).collect()}
    assert got == {(1, "auth", "", "preauthorize"), (1, "parameter", "path", "id"), (1, "parameter", "query", "q"), (1, "parameter", "header", "X-T"), (2, "auth", "", "getheader"), (3, "auth", "", "useguards"), (3, "parameter", "query", "page"), (3, "parameter", "body", "name")}


def test_values_of_changes_routes_and_targets(spark):
    """Each category, signal and rung with the values it must have."""
    from factloom.operators import predicates as P

    paths = {
        "src/tests/a.go": "tests", "a/b_test.go": "tests", "x/y.spec.ts": "tests", "readme.MD": "documentation", "a/docs/x.txt": "documentation", "db/migrations/1.sql": "data", "prisma/schema.prisma": "data", "api/openapi.yaml": "api", "p/x.proto": "api",
        "src/api/h.go": "api", "src/auth/login.go": "security", "lib/tls.rs": "security", "infra/main.tf": "infrastructure", "Dockerfile": "infrastructure", ".github/workflows/ci.yml": "infrastructure", "go.mod": "dependencies", "x/package.json": "dependencies",
        "config/app.yml": "configuration", ".env.prod": "configuration", "src/main.go": "code", "xgo.mod": "code",
    }
    got = one(spark, lambda c: P.changed_file_kind(F.col(c)), *paths)
    assert dict(zip(paths, got)) == paths
    patches = spark.createDataFrame([("a.go", "-func X()"), ("a.go", "ALTER TABLE t"), ("src/auth/x", None), ("x/openapi.json", "-export const")], "f string, t string")
    assert [r.s for r in patches.select(P.file_signals(F.col("f"), F.col("t")).alias("s")).collect()] == [["public_surface_removal"], ["destructive_schema"], ["security_boundary"], ["contract_change", "public_surface_removal"]]
    assert one(spark, lambda c: P.type_name(F.lit("dependency"), F.col(c)), "SQL Query", "http-client", "other") == ["db_operation", "outbound_http", "other"]
    dep = "instance string, details string, tags array<string>, evidence array<struct<snippet: string>>, name string"
    rows = [
        (" h1 ", '{"url": "u"}', None, None, "n"), ("HTTP", '{"host": "h", "base_url": "b"}', None, None, "n"), (None, '{"url": 7, "topic": "t", "table": "x"}', [], None, "n"), ("redis", '{"url": "kafka"}', ["x", "cart-service"], None, "n"),
        ("", "no json", ["a"], [(None,), ('get("https://q.internal/x");',)], "n"), (None, None, None, None, " n "),
    ]
    t = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {dep}")
    assert [r.t for r in t.select("i", P.target(t).alias("t")).orderBy("i").collect()] == ["h1", "b", "t", "cart-service", "get(\"https://q.internal/x", "n"]
    fact = lambda i, kind, service, path: (i, "p", "outbound_http" if kind == "d" else "http_route", service, "GET", path, f"GET {path}")
    generic = [*resolve.GENERIC_ROUTES, "/actuator/info", "/swagger-ui", "/health/live", "/.well-known/x"]
    rows = [x for i, path in enumerate([*generic, "/orders/{id}"]) for x in (fact(f"d{i}", "d", "a", path), fact(f"e{i}", "e", "b", path))]
    f = spark.createDataFrame(rows, "entity_id string, project_id string, type string, service string, d_method string, d_path string, name string")
    assert [r.entity_id for r in resolve.route_matches(f).collect()] == [f"d{len(generic)}"]


def test_a_route_of_many_owners_stays_ambiguous(spark):
    row = lambda i, t, s, m, p: (i, "p", t, s, m, p, "")
    rows = [row(f"e{i}", "http_route", f"s{i % 7}", "GET", "/hot") for i in range(700)] + [row("x1", "http_route", "s1", "POST", "/one"), row("x2", "webhook", "s2", "POST", "/one"), row("x0", "http_route", "s1", "", "/one")]
    rows += [row("d1", "outbound_http", "q", "GET", "/hot"), row("d2", "outbound_http", "s2", "POST", "/one"), row("d3", "outbound_http", "s1", "POST", "/one"), row("d4", "outbound_http", "s3", "", "/one"), row("d5", "outbound_http", "s0", "GET", "/one")]
    f = spark.createDataFrame(rows, "entity_id string, project_id string, type string, service string, d_method string, d_path string, name string")
    assert {(r.entity_id, r.to_service, r.to_entity) for r in resolve.route_matches(f).collect()} == {("d2", "s1", "x0"), ("d3", "s2", "x2"), ("d5", "s1", "x0")}
    q = spark.createDataFrame([(f"c{i}", "p", "queue_consumer", f"s{i % 3}", None, None, "consume Order.Placed") for i in range(90)] + [("p0", "p", "queue_publish", "s0", None, None, "publish order-placed"), ("p1", "p", "queue_publish", "s1", None, None, "publish order_placed")], f.schema)
    assert {(r.entity_id, r.to_service) for r in resolve.queue_matches(q).collect()} == {("p0", "s1"), ("p1", "s0")}


def test_claims_and_retries(spark):
    rows = [("j1", "p", "queued", T0, T0, False, 5), ("j2", "p", "queued", T0 - timedelta(1), T0, True, 5), ("j3", "q", "running", T0, T0, False, 5), ("j4", "q", "queued", T0, T0, False, 5), ("j5", "r", "failed", T0, T0, False, 2)]
    jobs = spark.createDataFrame(rows, "job_id string, project_id string, status string, not_before timestamp, created_at timestamp, cancel_requested boolean, max_attempts int")
    assert [r.job_id for r in J.claimable(jobs).collect()] == ["j1"]
    att = spark.createDataFrame([("j5", T0)], "job_id string, finished_at timestamp")
    assert [r.attempts for r in J.retry_at(att, jobs).collect()] == [1] and J.retry_at(att.union(att), jobs).count() == 0
    assert {r.job_id: r.status for r in J.recover(jobs).collect()}["j3"] == "interrupted"


def test_streamed_lanes(spark, tmp_path):
    src = str(tmp_path / "in")
    c = lambda n, cmd, job=None, dig=None, out=None: ("p", T0 + timedelta(seconds=n), cmd, job, dig, out)
    batches = [
        [c(1, "enqueue", "a", "d1"), c(2, "enqueue", "a", "d1"), c(3, "enqueue", "a", "d9"), c(4, "enqueue", "b", "d1"), c(5, "enqueue", "e", "d2"), c(6, "claim"), c(7, "claim")],
        [c(20, "finish", "a", out="failed"), c(21, "claim"), c(40, "recover"), c(41, "cancel", "a"), c(60, "claim"), c(70, "finish", "e", out="succeeded")],
    ]
    effects = []
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, SJ.COMMANDS).coalesce(1).write.mode("append").parquet(src)
        q = SJ.lanes(spark.readStream.schema(SJ.COMMANDS).parquet(src)).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(120)
    effects = [(r.job_id, r.effect) for r in spark.read.parquet(str(tmp_path / "out")).orderBy("at", "job_id").collect()]
    assert effects == [("a", "queued"), ("a", "repeated"), ("a", "conflict"), ("b", "coalesced"), ("e", "queued"), ("a", "claimed"), ("a", "retry"), ("e", "claimed"), ("e", "interrupted"), ("a", "cancelled"), ("e", "claimed"), ("e", "succeeded")]


def test_streamed_deliveries_windows_and_log(spark, tmp_path):
    rows = [("p", "d1", T0), ("p", "d1", T0), ("p", "d2", T0)]
    spark.createDataFrame(rows, "project_id string, delivery_id string, at timestamp").write.parquet(str(tmp_path / "d"))
    s = spark.readStream.schema("project_id string, delivery_id string, at timestamp").parquet(str(tmp_path / "d"))
    q = SJ.first_deliveries(s).writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "o")).count() == 2
    ev = spark.createDataFrame([("r", 1, "a"), ("r", 2, "b")], "run_id string, sequence long, text string")
    ev.write.parquet(str(tmp_path / "e"))
    for _ in range(2):
        SJ.event_log(spark.readStream.schema(ev.schema).parquet(str(tmp_path / "e")), str(tmp_path / "log"), str(tmp_path / "c2")).trigger(availableNow=True).start().awaitTermination(120)
    assert store.replay_events(spark, str(tmp_path / "log"), "run_id string, sequence long, text string, batch int").count() == 2
    b = spark.createDataFrame([(T0, "x", 1.0, 1), (T0 + timedelta(minutes=1), "x", 2.0, 1), (T0 + timedelta(minutes=50), "x", 4.0, 1)], "ts timestamp, event_type string, value double, user_id long")
    assert sorted(r.n for r in SJ.windowed_counts(b).collect()) == [1, 2] and sorted(r.n for r in SJ.sessions(b).collect()) == [1, 2]


def test_graph_store(spark):
    s = GraphStore(spark, SMALL)
    assert s.list_projects().count() >= 1 and s.list_services().count() > 1 and s.get_graph_summary().count() >= 3
    e = s.edges().limit(1).collect()[0]
    assert s.get_dependencies(e.src, "outbound").count() >= 1 and s.find_dependency_path(e.src, e.dst).collect()[0].status == "found"
    assert s.compare_graphs(s.edges(), s.edges()).count() == 0
    assert s.list_graph_runs(size=2).count() == 2 and s.search_architecture("order").count() > 0
    p = s.list_projects().collect()[0].project_id
    assert s.get_contracts(p).count() >= 0 and s.compare_contracts(p).columns and s.get_impact(e.dst).columns
    x = s.facts().limit(1).collect()[0]
    assert s.get_service(x.service).count() >= 1 and s.get_object_trace(x.entity_id).columns
    assert GraphStore(spark, SMALL, visible=[]).facts().count() == 0


def test_registry():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 150
    assert {k for k in q if k.startswith("p") and k.endswith("_found")} >= {"p1_found", "p5_found", "p6_found"}
