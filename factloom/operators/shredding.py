"""Deeply nested semi-structured records into related flat tables (adjacency-table shredding).

Every JSON text becomes rows of one adjacency table: node, parent, label, ordinal, scalar, plus the dotted path
without positions and the key of the enclosing record. Objects are then joined with their scalar children and pivoted
into entity tables. The join and the pivot are one grouping on (root, owning node); because all nodes of a text are
made by the same task, the map-side half of that grouping does nearly all of the work and only one row per record is
shuffled.

A collection may be a list, one bare record, a map from key to record (or to a type), bare names, or any of these as
JSON text; all are brought to the same adjacency form.

Defined results: null, blank or cut-off texts and texts that aren't objects give no rows; elements without a usable
key (null, blank, not scalar) give no rows; repeated keys and redelivered texts give one row; extra members are
ordinary scalars of their record.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from json.decoder import scanstring

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

NODES = (
    "table_name string, root_id string, text_hash long, node int, parent int, label string, ordinal int, "
    "kind string, scalar string, record_path string, member_path string, anchor_key string"
)


@dataclass(frozen=True)
class Collection:
    """Where records are found: member path from the enclosing record, members that make the key, nested collections.

    names: bare names and a map from name to type count as records (fields). tree: member holding nested properties.
    """

    path: tuple[str, ...]
    keys: tuple[str, ...] = ("id",)
    joiner: str = "/"
    names: bool = False
    tree: bool = False
    nested: tuple["Collection", ...] = ()


_PART = re.compile(r"[ \t\n\r]*(?:(?P<mark>[{}\[\],:])|(?P<quote>\")|(?P<number>-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<word>true|false|null|NaN|Infinity|-Infinity)|(?P<end>$))")
_WORDS = {"true": True, "false": False, "null": None, "NaN": float("nan"), "Infinity": float("inf"), "-Infinity": float("-inf")}


def read_deep(s: str):
    """The value of a JSON text nested more deeply than the standard reader goes; ValueError if it isn't one."""
    top: list = []
    stack: list = [top]  # the open lists and objects
    keys: list = [None]
    want, at = "value", 0
    while True:
        m = _PART.match(s, at)
        if not m:
            raise ValueError(f"no JSON at {at}")
        at, mark = m.end(), m["mark"]
        if m["end"] is not None:
            if len(stack) > 1 or not top:
                raise ValueError("the text is cut off")
            return top[0]
        if mark in ("]", "}"):
            if len(stack) < 2 or isinstance(stack[-1], dict) != (mark == "}") or want not in ("next", "first"):
                raise ValueError(f"no JSON at {at}")
            stack.pop()
            keys.pop()
            want = "next"
        elif mark == ",":
            if want != "next" or len(stack) < 2:
                raise ValueError(f"no JSON at {at}")
            want = "key" if isinstance(stack[-1], dict) else "value"
        elif mark == ":":
            if want != "colon":
                raise ValueError(f"no JSON at {at}")
            want = "value"
        else:
            if m["quote"]:
                v, at = scanstring(s, at, True)
            elif m["number"]:
                v = json.loads(m["number"])
            else:
                v = _WORDS[m["word"]] if m["word"] else {} if mark == "{" else []
            holder = stack[-1]
            if isinstance(holder, dict) and want in ("key", "first"):
                if not m["quote"]:
                    raise ValueError(f"no JSON at {at}")
                keys[-1], want = v, "colon"
                continue
            if want not in ("value", "first") or holder is top and top:
                raise ValueError(f"no JSON at {at}")
            if isinstance(holder, dict):
                holder[keys[-1]] = v
            else:
                holder.append(v)
            want = "next"
            if mark:
                stack.append(v)
                keys.append(None)
                want = "first"


def decoded(value):
    """The value, read as JSON as long as it is JSON text of an object, list or string, however deep and however often."""
    while isinstance(value, str):
        s = value.strip().lstrip("\ufeff").strip()
        if s[:1] not in ("{", "[", '"'):
            return value
        try:
            value = json.loads(s)
        except RecursionError:
            try:
                value = read_deep(s)
            except ValueError:
                return value
        except ValueError:
            return value
    return value


def text_of(v) -> str | None:
    """A scalar as text: numbers without a superfluous fraction, flags in lower case."""
    if v is None or isinstance(v, (dict, list)):
        return None
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, float) and v.is_integer():
        return str(int(v))
    return str(v)


def _key_of(v: dict, c: Collection) -> str | None:
    parts = [text_of(v.get(k)) for k in c.keys]
    if any(p is None or not p.strip() for p in parts):
        return None
    return "->".join(p.strip() for p in parts)


def elements(value, c: Collection) -> Iterator[tuple[str | None, object, bool]]:
    """(label, element, is a bare name) of a collection in any of its shapes."""
    value = decoded(value)
    if isinstance(value, list):
        for e in value:
            e = decoded(e)
            if isinstance(e, dict):
                if _key_of(e, c) is None and len(c.keys) == 1 and len(e) == 1 and isinstance(next(iter(e.values())), dict):
                    yield from elements(e, c)  # a list of one-entry maps
                else:
                    yield None, e, False
            elif c.names and isinstance(e, str):
                yield None, e, True
    elif isinstance(value, dict):
        own = _key_of(value, c)
        if own is not None and (len(value) == 1 or not all(isinstance(x, dict) for x in value.values())):
            yield None, value, False
        elif len(c.keys) == 1:
            for k, e in value.items():
                e = decoded(e)
                if isinstance(e, dict):
                    yield k, e, False
                elif c.names and (isinstance(e, str) or e is None):
                    yield k, {"type": e}, False
    elif c.names and isinstance(value, str) and value.strip():
        yield None, value, True


def _holds(c: Collection, names) -> bool:
    """Whether records of the collection are made from what lies at a chain of names; a schema's are its properties, also below items."""
    if c.tree:
        if names[1] != "properties":
            return False
        names = names[0]
        while names is not None and names[1] == "items":
            names = names[0]
    return _chain(names, len(c.path)) == c.path


def _chain(end, most: int | None = None) -> tuple[str, ...] | None:
    """The parts of a chain (what is before, own part) in order; None if there are more than `most`."""
    out = []
    while end is not None:
        if len(out) == most:
            return None
        end, part = end
        out.append(part)
    return tuple(reversed(out))


class Shredder:
    """Makes the adjacency rows of one text; members: the scalars to keep, None for all."""

    def __init__(self, table: str, root: str, text_hash: int, out: list, members: frozenset[str] | None):
        self.table, self.root, self.hash, self.out, self.members, self.n = table, root, text_hash, out, members, 0

    def row(self, parent: int, label, ordinal: int, kind: str, scalar, path: str, members: str, anchor) -> int:
        self.n += 1
        self.out.append((self.table, self.root, self.hash, self.n, parent, label, ordinal, kind, scalar, path, members, anchor))
        return self.n

    def scalars(self, v: dict, at: int, path: str, inside: tuple[Collection, ...], above: tuple[str, ...] = ()) -> None:
        """Scalars of a record at any depth, but for those of the collections inside, whose elements are records of their own.

        Scalars of a list have its label and their place as ordinal; objects and lists in a list have it in the label.
        """
        if self.members is not None:
            for i, (k, x) in enumerate(v.items()):
                if k in self.members and (s := text_of(x)) is not None:
                    self.row(at, k, i, "scalar", s, path, "", None)
            return
        # labels and names are chains, written out only where they are needed
        start = None
        for k in above:
            start = (start, k)
        stack = [((None, k), i, x, (start, k)) for i, (k, x) in reversed([*enumerate(v.items())])]
        while stack:
            label, i, x, names = stack.pop()
            if isinstance(x, (dict, list, str)) and any(_holds(c, names) for c in inside) and isinstance(decoded(x), (dict, list)):
                continue
            if isinstance(x, dict):
                stack += [((label, k), j, y, (names, k)) for j, (k, y) in reversed([*enumerate(x.items())])]
            elif isinstance(x, list):
                stack += [((label, str(j)) if isinstance(y, (dict, list)) else label, j, y, (names, "") if isinstance(y, (dict, list)) else names) for j, y in reversed([*enumerate(x)])]
            elif (s := text_of(x)) is not None:
                self.row(at, ".".join(_chain(label)), i, "scalar", s, path, "", None)

    def collection(self, holder, c: Collection, at: int, path: str, anchor: str) -> None:
        v = decoded(holder)
        for m in c.path:
            if not isinstance(v, dict):
                return
            v = decoded(v.get(m))
        where = ".".join((path, *c.path)) if path else ".".join(c.path)
        if c.tree:
            self.tree(v, at, where, anchor, ())
            return
        for i, (label, e, bare) in enumerate(elements(v, c)):
            key = e.strip() if bare else _key_of(e, c)
            key = label if key is None else key
            if not key or not str(key).strip():
                continue
            me = self.row(at, label if label is not None else c.path[-1], i, "object", None, where, "", anchor)
            if bare:
                self.row(me, c.keys[0], 0, "scalar", key, where, "", None)
                continue
            if _key_of(e, c) is None:  # a map's key is the record's key
                self.row(me, c.keys[0], 0, "scalar", str(key), where, "", None)
            self.scalars(e, me, where, c.nested)
            for n in c.nested:
                self.collection(e, n, me, where, str(key))

    def tree(self, schema, at: int, path: str, anchor: str, above: tuple[str, ...]) -> None:
        """Properties at any depth; an array's item properties count as its children."""
        stack = [(schema, at, above)]
        while stack:
            s, parent, names = stack.pop()
            s = decoded(s)
            if not isinstance(s, dict):
                continue
            inner = decoded(s.get("items"))
            while isinstance(inner, dict):  # arrays of arrays
                stack.append(({"properties": inner.get("properties")}, parent, names))
                inner = decoded(inner.get("items"))
            props = decoded(s.get("properties"))
            if isinstance(props, list):
                props = {p.get("name"): p for p in map(decoded, props) if isinstance(p, dict) and isinstance(p.get("name"), str)}
            if not isinstance(props, dict):
                continue
            for i, (k, p) in enumerate(props.items()):
                if not k.strip():
                    continue
                p = decoded(p)
                here = (*names, k)
                me = self.row(parent, k, i, "object", None, path + ".properties", ".".join(here), anchor)
                self.row(me, "name", 0, "scalar", k, path + ".properties", "", None)
                if isinstance(p, dict):
                    self.scalars(p, me, path + ".properties", (Collection((), tree=True),))
                    stack.append((p, me, here))


def adjacency(texts: DataFrame, specs: dict[str, Iterable[Collection]], members: Iterable[str] | None = None, wrap: dict[str, str] | None = None) -> DataFrame:
    """Adjacency rows of texts(table_name, root_id, body); specs: the collections of each table_name.

    With all members, a text's root is an object node too, without a record path, and holds its scalars.
    wrap: the member under which a table's texts are placed, so that paths start with their column's name.
    """
    wrap = wrap or {}
    keep = None if members is None else frozenset(members)
    specs = {k: tuple(v) for k, v in specs.items()}

    schema = to_arrow_schema(StructType.fromDDL(NODES))

    def shred(batches):
        import pyarrow as pa

        for b in batches:
            out: list[tuple] = []
            for table, root, h, body in zip(*(c.to_pylist() for c in b.columns)):
                if root is None or body is None:
                    continue
                doc = own = decoded(body)
                above = (wrap[table],) if table in wrap else ()
                if above:
                    doc = {wrap[table]: doc}
                if isinstance(doc, dict):
                    s, at = Shredder(table, root, h, out, keep), 0
                    if keep is None and isinstance(own, dict):
                        at = s.row(0, "".join(above), 0, "object", None, "", "", root)
                        s.scalars(own, at, "", specs.get(table, ()), above)
                    for c in specs.get(table, ()):
                        s.collection(doc, c, at, "", root)
            for at in range(0, len(out), 50_000):
                cols = list(zip(*out[at : at + 50_000]))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    narrow = texts.select("table_name", F.col("root_id").cast("string").alias("root_id"), F.xxhash64("body").alias("h"), "body")
    return narrow.mapInArrow(shred, NODES)


def flow_nodes(docs: DataFrame) -> DataFrame:
    """(doc, flow_id, pos, ref, role): the nodes of the flows in docs(doc, body), both in any shape; keys aren't needed."""

    def members(value, c: Collection, own: tuple[str, ...]) -> Iterator[tuple[str | None, dict]]:
        value = decoded(value)
        if isinstance(value, dict) and _key_of(value, c) is None and any(m in value and not isinstance(value[m], dict) for m in own):
            value = [value]  # a bare record without a key
        for label, e, _ in elements(value, c):
            yield label, e

    flows, nodes = Collection(("flows",)), Collection(("nodes",))
    schema = "doc string, flow_id string, pos int, ref string, role string"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def read(batches):
        import pyarrow as pa

        for b in batches:
            out = []
            for doc, body in zip(*(c.to_pylist() for c in b.columns)):
                d = decoded(body)
                for label, f in members(d.get("flows"), flows, ("nodes", "edges")) if isinstance(d, dict) else ():
                    own = text_of(f.get("id"))
                    for pos, (_, n) in enumerate(members(f.get("nodes"), nodes, ("ref", "role"))):
                        out.append((doc, own if own is not None else label, pos, text_of(n.get("ref")), text_of(n.get("role"))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    return docs.select("doc", "body").mapInArrow(read, schema)


def _scalar(*labels: str) -> Column:
    return F.coalesce(*(F.max(F.when((F.col("kind") == "scalar") & (F.col("label") == m), F.col("scalar"))) for m in labels))


def _attributes(rows: Column) -> Column:
    """Scalars by label; several of one label, those of a list, are joined in their order."""
    labels = F.array_distinct(F.transform(rows, lambda x: x["label"]))
    joined = lambda k: F.array_join(F.transform(F.filter(rows, lambda x: x["label"] == k), lambda x: x["scalar"]), ",")
    return F.map_from_entries(F.transform(labels, lambda k: F.struct(k.alias("key"), joined(k).alias("value"))))


def records(nodes: DataFrame, pivot: dict[str, str] | None = None) -> DataFrame:
    """Object nodes joined with their scalar children: one row per record, with its link to the parent.

    pivot: output column -> scalar label; without it all scalars come as the map `attributes`.
    """
    own = F.when(F.col("kind") == "scalar", F.col("parent")).otherwise(F.col("node"))
    is_obj = F.col("kind") == "object"
    key = F.coalesce(_scalar("id"), _scalar("name"), _scalar("status"), F.concat(_scalar("from"), F.lit("->"), _scalar("to")))
    more = (
        [F.max(F.when((F.col("kind") == "scalar") & (F.col("label") == m), F.col("scalar"))).alias(c) for c, m in pivot.items()]
        if pivot is not None
        else [_attributes(F.array_sort(F.collect_set(F.when(F.col("kind") == "scalar", F.struct("label", "place", "scalar"))))).alias("attributes")]
    )
    g = (
        nodes.withColumn("owner", own).withColumn("place", F.col("ordinal"))
        .groupBy("table_name", "root_id", "text_hash", "owner")
        .agg(
            F.max(F.when(is_obj, F.col("record_path"))).alias("record_path"),
            F.max(F.when(is_obj, F.col("member_path"))).alias("member_path"),
            F.max(F.when(is_obj, F.col("anchor_key"))).alias("anchor_key"),
            F.max(F.when(is_obj, F.col("ordinal"))).alias("ordinal"),
            key.alias("own_key"),
            *more,
        )
        .where(F.col("record_path") != "")
    )
    up = F.regexp_replace("member_path", r"\.?[^.]*$", "")
    top = F.col("record_path").rlike(TOP)
    is_property = F.col("member_path") != ""
    return g.select(
        "table_name",
        "root_id",
        "record_path",
        F.when(is_property, F.concat_ws("/", "anchor_key", "member_path")).when(top, F.col("own_key")).otherwise(F.concat_ws("/", "anchor_key", "own_key")).alias("record_id"),
        F.when(is_property & (up != ""), F.concat_ws("/", F.col("anchor_key"), up)).otherwise(F.col("anchor_key")).alias("parent_id"),
        "ordinal",
        *((list(pivot)) if pivot is not None else ["attributes"]),
    )


#: Paths whose records carry an id that is unique in the root; others are qualified by the enclosing record's key.
TOP = r"^(objects\.[a-z_]+|flows|evidence)$"

OBJECT_ARRAYS = (
    "http_calls", "db_resources", "db_queries", "queue_consumers", "queue_publishers", "rpc_endpoints", "rpc_calls",
    "cli_commands", "activations", "cache_operations", "config_reads", "feature_flags",
)
FIELD = ("path_params", "query_params", "headers")
DETAIL_FIELDS = ("request_fields", "body_fields", "query_params", "path_params", "headers")

SPECS: dict[str, tuple[Collection, ...]] = {
    "service_docs": (
        Collection(
            ("objects", "http_endpoints"),
            nested=(
                *(Collection(("inputs", f), keys=("name",), names=True) for f in FIELD),
                Collection(("inputs", "body", "schema"), tree=True),
                Collection(("responses",), keys=("status",)),
            ),
        ),
        *(Collection(("objects", a)) for a in OBJECT_ARRAYS),
        Collection(
            ("flows",),
            nested=(Collection(("nodes",)), Collection(("edges",), keys=("from", "to")), Collection(("data_dependencies",))),
        ),
        Collection(("evidence",)),
    ),
    "entities": tuple(
        Collection((*at, k), keys=("name",), names=True) for at in (("details",), ("details", "metadata", "details")) for k in DETAIL_FIELDS
    ),
}


def project_texts(service_docs: DataFrame, entities: DataFrame) -> DataFrame:
    """The JSON texts of both tables in one shape."""
    docs = service_docs.select(F.lit("service_docs").alias("table_name"), F.col("service_doc_id").cast("string").alias("root_id"), "body")
    det = entities.where(F.col("details").isNotNull()).select(
        F.lit("entities").alias("table_name"), F.col("entity_id").alias("root_id"), F.col("details").alias("body")
    )
    return docs.unionByName(det)
