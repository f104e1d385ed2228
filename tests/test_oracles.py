"""Queries of every section against their SQL counterparts in DuckDB, on the smallest tables."""

import math
import os
from collections import Counter
from pathlib import Path

import pytest

import __spark_entry__ as entry

SMALL = Path("/root/testdata/sf0.001")
NAMES = (
    "f2_service_aliases f4_queue_names f7_route_normal f18_semantic_keys f24_config_profile pr3_grouping pr10_transport_duplicates pr24_patch_signals a1_edge_aggregation a5_connectivity a12_dedupe_dependencies a13_datastore_dedupe "
    "a22_config_consensus j1_rule_targets j3_route_stripped j5_tiered_identity j15_client_merge j16_position_containment g1_graph_edges g8_object_trace g9_shortest_path g10_blast_radius g14_call_paths g21_graph_diff g22_contract_diff "
    "w1_best_edges l8_top_areas u4_multiset_difference t3_claim t6_transitions s16_latest_snapshot s20_catalog_import x2_sql_operations p5_found p6_found"
).split()


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    return round(float(x), 6) if isinstance(x, (int, float)) and not isinstance(x, bool) else x


@pytest.fixture(scope="module")
def sql():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for p in SMALL.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p if p.is_file() else p / '*.parquet'}')")
    return con


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the test tables")
@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, sql, name):
    df = entry.queries()[name](spark, str(SMALL))
    cols = sorted(df.columns)
    mine = Counter(tuple(plain(v) for v in r) for r in df.select(cols).collect())
    cur = sql.execute(entry.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    theirs = Counter(tuple(plain(r[i]) for i in at) for r in cur.fetchall())
    assert mine == theirs
