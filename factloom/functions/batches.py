"""Python over rows in Arrow batches, where built-in expressions can't say it."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame


def map_rows(df: DataFrame, schema: str, rows: Callable[..., Iterable[tuple]], most: int = 20_000) -> DataFrame:
    """rows(*columns of one row) -> output rows, taken as they come, in batches of `most`."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        import pyarrow as pa

        def batch(out):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

        out: list[tuple] = []
        for b in batches:
            for values in zip(*(c.to_pylist() for c in b.columns)):
                for row in rows(*values):
                    out.append(row)
                    if len(out) >= most:
                        yield batch(out)
                        out = []
        if out:
            yield batch(out)

    return df.mapInArrow(run, schema)
