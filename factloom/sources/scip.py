"""Precomputed symbol indexes in their protocol-buffer form, as tables of occurrences, symbols and implementations.

Only the wire format is read: an index holds documents (2) and external symbols (3); a document its path (1), occurrences (2),
symbols (3) and language (4); an occurrence its range (1), symbol (2) and roles (3); a symbol its name (1), relationships (4),
kind (5), display name (6); a relationship its symbol (1) and whether it implements (3). Unknown fields are skipped.

Defined results: a file that breaks off gives the documents before; lines count from 0 as in the index; a range of three
numbers ends on its own line; local symbols are qualified by their document.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.batches import map_rows

DEFINITION = 1  # the role bit of a definition; fixed value
ROWS = "index_path string, row_kind string, document string, language string, symbol string, start_line int, start_char int, end_line int, end_char int, is_definition boolean, target string"


def _varint(b: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = b[at]
        at += 1
        value |= (byte & 0x7F) << shift
        if byte < 0x80:
            return value, at
        shift += 7


def fields(b: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a message: a number, or the bytes of a text, message or packed list; ends where the bytes break off."""
    at = 0
    try:
        while at < len(b):
            key, at = _varint(b, at)
            number, wire = key >> 3, key & 7
            if wire == 0:
                value, at = _varint(b, at)
            elif wire == 2:
                size, at = _varint(b, at)
                if at + size > len(b):
                    return
                value, at = b[at : at + size], at + size
            elif wire in (1, 5):
                size = 8 if wire == 1 else 4
                value, at = int.from_bytes(b[at : at + size], "little"), at + size
            else:
                return
            yield number, value
    except IndexError:
        return


def _packed(v) -> list[int]:
    out, at = [], 0
    if isinstance(v, int):
        return [v]
    while at < len(v):
        n, at = _varint(v, at)
        out.append(n)
    return out


def _text(v) -> str:
    return v.decode("utf-8", "replace") if isinstance(v, bytes) else ""


def rows(path: str, content: bytes | None) -> Iterator[tuple]:
    """The rows of one index."""
    for number, doc in fields(content or b""):
        if number != 2 or not isinstance(doc, bytes):
            continue
        name = language = ""
        occurrences, symbols = [], []
        for k, v in fields(doc):
            if k == 1:
                name = _text(v)
            elif k == 4:
                language = _text(v)
            elif k == 2 and isinstance(v, bytes):
                occurrences.append(v)
            elif k == 3 and isinstance(v, bytes):
                symbols.append(v)
        own = lambda s: f"{name}#{s}" if s.startswith("local ") else s
        for o in occurrences:
            at, symbol, roles = [], "", 0
            for k, v in fields(o):
                if k == 1:
                    at += _packed(v)
                elif k == 2:
                    symbol = _text(v)
                elif k == 3 and isinstance(v, int):
                    roles = v
            if symbol and len(at) in (3, 4):
                end = (at[0], at[2]) if len(at) == 3 else (at[2], at[3])
                yield path, "occurrence", name, language, own(symbol), at[0], at[1], *end, bool(roles & DEFINITION), None
        for s in symbols:
            symbol, related = "", []
            for k, v in fields(s):
                if k == 1:
                    symbol = _text(v)
                elif k == 4 and isinstance(v, bytes):
                    r = dict(fields(v))
                    if r.get(3):
                        related.append(_text(r.get(1)))
            yield from ((path, "implements", name, language, own(symbol), None, None, None, None, None, t) for t in related if t)


def read_index(spark: SparkSession, root: str) -> DataFrame:
    """Rows of all *.scip files below a folder."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.scip").load(root)
    return map_rows(f.select("path", "content"), ROWS, rows)


def definitions(index: DataFrame) -> DataFrame:
    """(symbol, document, start_line, start_char): the first definition of each symbol."""
    d = index.where("row_kind = 'occurrence' and is_definition")
    return d.groupBy("symbol").agg(F.min(F.struct("document", "start_line", "start_char")).alias("d")).select("symbol", "d.*")


def implementations(index: DataFrame) -> DataFrame:
    """(interface, implementation) as the index states them."""
    return index.where("row_kind = 'implements'").select(F.col("target").alias("interface"), F.col("symbol").alias("implementation")).distinct()


def symbol_at(index: DataFrame, positions: DataFrame) -> DataFrame:
    """positions(position_id, document, line) with the symbols that occur on the line."""
    o = index.where("row_kind = 'occurrence'").select("document", F.col("start_line").alias("line"), "symbol", "is_definition")
    return positions.join(o, ["document", "line"]).select("position_id", "symbol", "is_definition").distinct()
