"""Helpers for operators that find spans in texts and mask them; no shuffle, one Arrow pass over whole texts."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame


def lowered(text: str) -> str:
    """Lower case with the same length, so that positions hold."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def settle(spans: Iterable[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Spans without overlap: the earlier start wins, of equal starts the longer one, then the first kind in order."""
    out: list[tuple[int, int, str]] = []
    for s in sorted(set(spans), key=lambda x: (x[0], -x[1], x[2])):
        if not out or s[0] >= out[-1][1]:
            out.append(s)
    return out


def masked(text: str, spans: list[tuple[int, int, str]], mask: Callable[[str, str], str]) -> str:
    """The text with each span replaced by mask(kind, span text)."""
    parts, at = [], 0
    for lo, hi, kind in spans:
        parts += [text[at:lo], mask(kind, text[lo:hi])]
        at = hi
    return "".join([*parts, text[at:]])


def map_rows(df: DataFrame, schema: str, rows: Callable[..., Iterable[tuple]]) -> DataFrame:
    """rows(*columns of one row) -> output rows, by Arrow batches of bounded size."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        import pyarrow as pa

        def batch(out):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

        for b in batches:
            out: list[tuple] = []
            for values in zip(*(c.to_pylist() for c in b.columns)):
                out.extend(rows(*values))
                if len(out) >= 20_000:
                    yield batch(out)
                    out = []
            if out:
                yield batch(out)

    return df.mapInArrow(run, schema)
