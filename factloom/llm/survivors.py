"""One surviving record per group of duplicates, built field by field from the most trusted records.

Each record has a trust rank, a confidence and a time. A holder of a field (a record where it isn't blank) is dominated
if another holder is at least as good on all three and better on one. Fields that depend on each other form a bundle;
functional dependencies inside a bundle say which values may stand together. The survivor is found by branch and bound
over the bundles: each field takes one of its undominated holders; where dependencies can't all hold, the fewest are
broken; then the sum of trust is maximised, and a bundle is taken whole from one record where that costs nothing. A field
with one undominated holder has no choice, whatever the rest of its bundle does: the stated problem takes each field from
the record that is best for it.

Scale: a group may hold a third of all rows. A map-side combiner reduces the rows of a task, whenever 50,000 have come
together, to the records that are undominated in some field (of those of equal quality one for each combination of the
bundle's values) and per field one holder of the smallest and one of the largest value (whether values differ is a
statement about all of them). So a hot group sends a few rows a task, and its last task reduces them again as they come.
Reducing twice gives the same as reducing once, so the result doesn't depend on how rows are spread.

Defined results: redelivered rows (same key) are one record; null confidence and null time are lowest; records without
a known source rank last; absent status is verified; ties in all three go to the smallest key and are marked chosen, not
dominant; groups of one give themselves; rows without a key take no part; connections with a blank reference form no group.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce as fold

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import key as text_key
from factloom.functions.text import present

LAST = 1_000_000
Record = tuple  # (id, rank, confidence, time, value of each field)


def _undominated(records: list[Record], at: int) -> list[list[Record]]:
    """The undominated holders of the field at this position: lists of equal quality in order of the smallest key, best first."""
    by: dict[tuple, dict[str, Record]] = {}
    for r in records:
        if r[at] is not None:
            by.setdefault((r[1], -r[2], -r[3]), {})[r[0]] = r
    best: list[tuple] = []
    for q in sorted(by):
        if not any(b[1] <= q[1] and b[2] <= q[2] for b in best):  # their ranks are not worse, as the order goes
            best.append(q)
    return [[by[q][k] for k in sorted(by[q])] for q in best]


def frontier(records: list[Record], at: int, bundle: Iterable[int] = ()) -> list[list[Record]]:
    """The undominated holders that can matter: of those of equal quality one for each combination of the bundle's values.

    Two are kept where there are two, because only a single one is dominant.
    """
    own = sorted({at, *bundle})
    out = []
    for tied in _undominated(records, at):
        kept: dict[tuple, Record] = {}
        for r in tied:
            kept.setdefault(tuple(r[i] for i in own), r)
        level = list(kept.values())
        out.append(level if len(level) > 1 else tied[:2])
    return out


def reduced(records: Iterable[Record], fields: int, bundles: Iterable[Iterable[int]] = ()) -> list[Record]:
    """The records that can matter for the group's survivor; bundles: positions of fields that depend on each other."""
    own = list({r[0]: r for r in sorted(records, key=lambda r: tuple((x is None, x) for x in r), reverse=True)}.values())
    if len(own) <= 2:
        return own
    keep = {min(own)[0]: min(own, key=lambda r: r[0])}
    with_ = {at: tuple(b) for b in bundles for at in b}
    for at in range(4, 4 + fields):
        held = [r for r in own if r[at] is not None]
        if held:
            for r in (*(r for level in frontier(held, at, with_.get(at, ())) for r in level), min(held, key=lambda r: (r[at], r[0])), max(held, key=lambda r: (r[at], r[0]))):
                keep[r[0]] = r
    return list(keep.values())


def choose(records: list[Record], fields: list[str], bundles: list[list[str]], dependencies: list[tuple[str, str]]) -> dict[str, tuple[Record, bool]]:
    """field -> (record, whether it is the only undominated holder).

    Each bundle is searched by branch and bound: fewest broken dependencies, then most trust, then fewest records, then
    smallest keys. Trust of a field is 1 for its best holders, a half for the next best, a third, and so on; holders of
    equal quality have equal trust. Whole bundles of one record are tried first; a branch ends where what is broken
    already, the most that the open fields can add, and the records used so far can't give a better result.
    """
    place = {f: 4 + i for i, f in enumerate(fields)}
    if len(records) == 1:
        return {f: (records[0], True) for f, i in place.items() if records[0][i] is not None}
    out: dict[str, tuple[Record, bool]] = {}
    for bundle in bundles or [[f] for f in fields]:
        at = [place[f] for f in bundle]
        levels = {f: c for f in bundle if (c := frontier(records, place[f], at))}
        own = sorted(levels, key=lambda f: (sum(map(len, levels[f])), f))
        if not own:
            continue
        if len(own) == 1:  # nothing to go with: the best holder of the smallest key
            out[own[0]] = levels[own[0]][0][0], sum(map(len, levels[own[0]])) == 1
            continue
        holders = {f: [(r, 1 / (1 + k)) for k, level in enumerate(levels[f]) for r in level] for f in own}
        trust = {f: {r[0]: t for r, t in holders[f]} for f in own}
        every = {r[0]: r for f in own for r, _ in holders[f]}.values()
        rules = []
        for a, b in dependencies:
            if a in own and b in own:
                pairs = {(r[place[a]], r[place[b]]) for r in every if r[place[a]] is not None and r[place[b]] is not None}
                rules.append((a, b, {x for x, _ in pairs}, pairs))
        ahead = [0.0] * (len(own) + 1)  # the most that the fields still open can add
        for i in range(len(own) - 1, -1, -1):
            ahead[i] = ahead[i + 1] + max(trust[own[i]].values())
        best: tuple | None = None
        found: dict[str, Record] = {}
        picked: dict[str, Record] = {}

        def broken() -> int:
            n = 0
            for a, b, known, pairs in rules:
                if a in picked and b in picked:
                    left, right = picked[a][place[a]], picked[b][place[b]]
                    n += left in known and (left, right) not in pairs
            return n

        def search(i: int, sum_: float) -> None:
            nonlocal best, found
            score = (-broken(), round(sum_ + ahead[i], 9), -len({r[0] for r in picked.values()}))
            if best is not None and score <= best:
                return
            if i == len(own):
                best, found = score, dict(picked)
                return
            f = own[i]
            for r, t in holders[f]:
                picked[f] = r
                search(i + 1, sum_ + t)
                del picked[f]

        for r, _ in holders[own[0]]:
            if all(r[0] in trust[f] for f in own):
                picked = {f: r for f in own}
                search(len(own), sum(trust[f][r[0]] for f in own))
        picked = {}
        search(0, 0.0)
        out |= {f: (found[f], len(holders[f]) == 1) for f in own}
    return out


def survivors(rows: DataFrame, table: str, fields: list[str], bundles: list[list[str]], dependencies: list[tuple[str, str]], flush: int = 50_000) -> DataFrame:
    """One row per group and held field: table_name, group_id, field_name, value, record_id, dominant, differing.

    rows: group_key, record_id, trust_rank int, confidence double, at long, then the fields as trimmed text or null.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    n = len(fields)
    joint = [[4 + fields.index(f) for f in b] for b in bundles if len(b) > 1]
    cols = ["group_key", "record_id", "trust_rank", "confidence", "at", *fields]
    narrow = rows.select(*cols).where(F.col("group_key").isNotNull() & F.col("record_id").isNotNull())
    arrow = to_arrow_schema(narrow.schema)

    def combine(batches):
        import pyarrow as pa

        held: dict[str, list[Record]] = {}
        seen = 0

        def out():
            flat = [(k, *r) for k, rs in held.items() for r in (reduced(rs, n, joint) if len(rs) > 2 else rs)]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*flat), arrow)], schema=arrow)

        for b in batches:
            for k, *r in zip(*(c.to_pylist() for c in b.columns)):
                held.setdefault(k, []).append(tuple(r))
            seen += b.num_rows
            if seen >= flush:
                # groups shrink in place, so a hot one leaves its task once; only many small ones make room
                held = {k: reduced(rs, n, joint) if len(rs) > 2 else rs for k, rs in held.items()}
                seen = sum(map(len, held.values()))
                if 2 * seen > flush:
                    yield out()
                    held, seen = {}, 0
        if held:
            yield out()

    found = "table_name string, group_id string, field_name string, value string, record_id string, dominant boolean, differing boolean"

    def finish(batches):
        import pyarrow as pa

        group, key, out = [], None, []

        def close():
            own = reduced(group, n, joint)
            gid = min(r[0] for r in own)
            for f, (r, only) in choose(own, fields, bundles, dependencies).items():
                at = 4 + fields.index(f)
                out.append((table, gid, f, r[at], r[0], only, len({x[at] for x in own if x[at] is not None}) > 1))

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["table_name", "group_id", "field_name", "value", "record_id", "dominant", "differing"])

        for b in batches:
            for k, *r in zip(*(c.to_pylist() for c in b.columns)):
                if k != key:
                    if group:
                        close()
                    group, key = [], k
                group.append(tuple(r))
                if len(group) >= flush:
                    group = reduced(group, n, joint)
            if out:
                yield batch()
                out.clear()
        if group:
            close()
        if out:
            yield batch()

    return narrow.mapInArrow(combine, narrow.schema).repartition("group_key").sortWithinPartitions("group_key").mapInArrow(finish, found)


def canonical(c: str) -> Column:
    """Name without case, blanks, hyphens and underscores, leading `service.`, closing slash; path parameters alike."""
    s = F.regexp_replace(F.lower(F.coalesce(F.col(c), F.lit(""))), r"[\s_\-]", "")
    s = F.regexp_replace(s, r"^service\.", "")
    s = F.regexp_replace(s, r"/(\{[^/}]*\}|<[^/>]*>|:[^/]+|\[[^/\]]*\])", "/{}")
    return F.regexp_replace(s, r"/+$", "")


def _ranked(df: DataFrame, ranks: DataFrame, scope: str, label: Column) -> DataFrame:
    """With trust_rank; source_ranks is a fixed table of a few labels, read as such."""
    known = {r.rank_label.strip().lower(): r.trust_rank for r in ranks.where(F.col("rank_scope") == scope).collect() if r.rank_label}
    pairs = [x for k, v in known.items() for x in (F.lit(k), F.lit(v))]
    rank = F.coalesce(F.create_map(*pairs)[label], F.lit(LAST)) if pairs else F.lit(LAST)
    return df.withColumn("trust_rank", rank.cast("int"))


def _quality(at: str) -> list[Column]:
    confidence = F.when(F.col("confidence").isNull() | F.isnan("confidence"), F.lit(float("-inf"))).otherwise(F.col("confidence"))
    return [F.col("trust_rank"), confidence.alias("confidence"), F.coalesce(F.unix_micros(at), F.lit(-(2**62))).alias("at")]


ENTITY_FIELDS = ["platform", "operation_kind", "summary", "host", "database"]
ENTITY_BUNDLES = [["platform", "operation_kind"], ["summary"], ["host", "database"]]
CONNECTION_FIELDS = ["summary", "condition_expr"]


def entity_survivors(entities: DataFrame, ranks: DataFrame) -> DataFrame:
    """Records of one fact agree in project, type, service and name; host decides which databases may stand with it."""
    group = F.concat_ws("\u0001", F.coalesce("project_id", F.lit("")), F.coalesce("type", F.lit("")), canonical("service"), canonical("name"))
    ref = [present(F.col(f"instance_ref.{f}")).alias(f) for f in ("host", "database")]
    rows = _ranked(entities, ranks, "instance_source", text_key(F.col("instance_ref.source"))).select(
        group.alias("group_key"), F.col("entity_id").alias("record_id"), *_quality("observed_at"), *(present(f).alias(f) for f in ENTITY_FIELDS[:3]), *ref
    )
    return survivors(rows, "entities", ENTITY_FIELDS, ENTITY_BUNDLES, [("host", "database")])


def connection_survivors(connections: DataFrame, ranks: DataFrame) -> DataFrame:
    """Records of one connection agree in both references and the path signature."""
    group = F.concat(text_key("from_exposure_id"), F.lit("\u0001"), text_key("to_dependency_id"), F.lit("\u0001"), F.coalesce("path_signature", F.lit("")))
    rows = _ranked(connections, ranks, "connection_status", F.coalesce(text_key("status"), F.lit("verified"))).select(
        group.alias("group_key"), F.col("connection_id").alias("record_id"), *_quality("created_at"), *(present(f).alias(f) for f in CONNECTION_FIELDS)
    )
    return survivors(rows, "connections", CONNECTION_FIELDS, [[f] for f in CONNECTION_FIELDS], [])


def project_survivors(entities: DataFrame, connections: DataFrame, ranks: DataFrame) -> DataFrame:
    return fold(DataFrame.unionByName, [entity_survivors(entities, ranks), connection_survivors(connections, ranks)])
