"""References to records that don't exist: range-partitioned sorted key arrays, probed by binary search.

Parent keys are range-partitioned and stored as sorted arrays of bounded length, one per range. References get the
range their key falls into, ranges with many references are salted over several tasks, and each task reads its array
once and probes the references in Arrow batches by binary search. Only misses leave the operator.

Memory: one array (keys_per_range keys) and one Arrow batch a task, whatever the skew. The driver sees the first key
of each range and a count per range, never the keys or references.

Defined results: blank and null references are no references; keys compare without outer white space and case; a
withdrawn parent (deleted_at set) doesn't exist unless another row of its key isn't withdrawn; a parent that arrives
later exists; redelivered references are one; a missing date gives a null period; with no parents every reference
dangles; with no references the result is empty.
"""

from __future__ import annotations

import math
from bisect import bisect_right

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import key as text_key
from factloom.session import cut

SEP = "\u0001"


def parents_of(df: DataFrame, kind: Column, key: str, deleted: str | None = "deleted_at") -> DataFrame:
    """(parent) of records that exist: kind and normalized key as one sortable string."""
    live = df.where(F.col(deleted).isNull()) if deleted else df
    return live.select(F.concat(kind, F.lit(SEP), text_key(key)).alias("parent")).where(F.col("parent").isNotNull())


def references_of(df: DataFrame, table: str, column: str, kind: str, child_key: str, at: str) -> DataFrame:
    """(child_table, child_column, child_key, ref_key, period, probe) of the references that are written."""
    ref = text_key(column)
    return df.select(
        F.lit(table).alias("child_table"),
        F.lit(column).alias("child_column"),
        F.col(child_key).alias("child_key"),
        ref.alias("ref_key"),
        F.date_format(at, "yyyy-MM").alias("period"),
        F.concat(F.lit(kind + SEP), ref).alias("probe"),
    ).where(F.col("ref_key").isNotNull())


def _ranges(parents: DataFrame, keys_per_range: int, tasks: int) -> DataFrame:
    """(lo, keys): sorted distinct parent keys in runs of at most keys_per_range."""

    def runs(batches):
        import pyarrow as pa

        schema = pa.schema([("lo", pa.string()), ("keys", pa.list_(pa.string()))])
        held: list[str] = []
        last = None
        for b in batches:
            for k in b.column(0).to_pylist():
                if k != last:
                    held.append(k)
                    last = k
                if len(held) == keys_per_range:
                    yield pa.RecordBatch.from_arrays([pa.array([held[0]]), pa.array([held], pa.list_(pa.string()))], schema=schema)
                    held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([held[0]]), pa.array([held], pa.list_(pa.string()))], schema=schema)

    # UTF-8 byte order of Spark equals code point order of Python
    ordered = parents.repartitionByRange(tasks, "parent").sortWithinPartitions("parent")
    return ordered.mapInArrow(runs, "lo string, keys array<string>")


def dangling(refs: DataFrame, parents: DataFrame, keys_per_range: int = 65_536, refs_per_task: int = 1_000_000) -> DataFrame:
    """The rows of refs whose probe is no parent."""
    spark = refs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = cut(_ranges(parents, keys_per_range, tasks))
    los = sorted(r.lo for r in ranges.select("lo").collect())  # one key per keys_per_range parents
    if not los:
        return refs
    held = spark.sparkContext.broadcast(los)

    def range_at(probes):
        import numpy as np

        at = held.value
        return np.fromiter((max(0, bisect_right(at, p) - 1) for p in probes), dtype=np.int64, count=len(probes))

    @F.pandas_udf("long")
    def range_of(probe: pd.Series) -> pd.Series:
        return pd.Series(range_at(probe))

    counted = refs.select((range_of("probe") if len(los) > 1 else F.lit(0)).alias("rng")).groupBy("rng").count()
    counts = {r["rng"]: r["count"] for r in counted.collect()}  # a number per range
    salts, first, at = [], [], 0
    for r in range(len(los)):
        first.append(at)
        salts.append(max(1, math.ceil(counts.get(r, 0) / refs_per_task)))
        at += salts[-1]
    layout = spark.createDataFrame([(lo, first[r], salts[r]) for r, lo in enumerate(los)], "lo string, first long, salts long")
    slots = spark.sparkContext.broadcast((first, salts))

    @F.pandas_udf("long")
    def slot_of(probe: pd.Series, salt: pd.Series) -> pd.Series:
        import numpy as np

        f, n = (np.asarray(x)[range_at(probe)] for x in slots.value)
        return pd.Series(f + salt.to_numpy() % n)

    cols = refs.columns
    salt = F.pmod(F.xxhash64("child_key", "probe"), F.lit(2**31))
    slot = slot_of("probe", salt) if at > 1 else F.lit(0).cast("long")
    left = refs.select(slot.alias("slot"), F.lit(1).alias("side"), *cols, F.lit(None).cast("array<string>").alias("keys"))
    right = ranges.join(layout, "lo").select(
        F.explode(F.sequence(F.col("first"), F.col("first") + F.col("salts") - 1)).alias("slot"),
        F.lit(0).alias("side"), *(F.lit(None).cast(t).alias(c) for c, t in refs.dtypes), "keys")
    both = left.unionByName(right).repartition(max(1, min(at, 4 * tasks)), "slot").sortWithinPartitions("slot", "side")

    def probe(batches):
        import numpy as np
        import pyarrow as pa

        keys, fixed = np.array([], dtype=object), None
        for b in batches:
            side = np.asarray(b.column("side"))
            slot = np.asarray(b.column("slot"))
            starts = np.flatnonzero(np.r_[True, (side[1:] == 0) | (slot[1:] != slot[:-1])])
            want = b.column("probe")
            miss = np.zeros(len(side), dtype=bool)
            for lo, hi in zip(starts, np.r_[starts[1:], len(side)]):
                if side[lo] == 0:
                    keys, fixed = sorted_array(b.column("keys")[int(lo)].as_py())
                    lo += 1
                if lo < hi:
                    miss[lo:hi] = ~found(keys, fixed, want.slice(lo, hi - lo).to_pylist())
            if miss.any():
                yield pa.RecordBatch.from_arrays([b.column(c).filter(pa.array(miss)) for c in cols], names=cols)

    return both.mapInArrow(probe, refs.schema)


def sorted_array(keys: list[str]):
    """The sorted keys as a numpy array of fixed-width bytes where that is exact, else of objects."""
    import numpy as np

    enc = [k.encode() for k in keys]
    if max(map(len, enc), default=0) <= 128 and not any(b"\0" in e for e in enc):
        return np.array(enc, dtype="S"), max(map(len, enc), default=1)
    return np.array(keys, dtype=object), None


def found(keys, width: int | None, wanted: list[str]):
    """Whether each wanted key is in the sorted array, by binary search."""
    import numpy as np

    if not len(keys):
        return np.zeros(len(wanted), dtype=bool)
    if width is None:
        w = np.array(wanted, dtype=object)
    else:
        enc = [x.encode() for x in wanted]
        w = np.array([e if len(e) <= width and b"\0" not in e else b"\xff" for e in enc], dtype=f"S{max(width, 1)}")
    at = np.minimum(np.searchsorted(keys, w), len(keys) - 1)
    return keys[at] == w


def project_references(connections: DataFrame, job_attempts: DataFrame) -> DataFrame:
    return (
        references_of(connections, "connections", "from_exposure_id", "exposure", "connection_id", "created_at")
        .unionByName(references_of(connections, "connections", "to_dependency_id", "dependency", "connection_id", "created_at"))
        .unionByName(references_of(job_attempts, "job_attempts", "job_id", "job", "attempt_id", "started_at"))
    )


def project_parents(entities: DataFrame, refresh_jobs: DataFrame) -> DataFrame:
    return parents_of(entities, F.lower(F.trim("kind")), "entity_id").unionByName(parents_of(refresh_jobs, F.lit("job"), "job_id"))


def dangling_references(connections: DataFrame, job_attempts: DataFrame, entities: DataFrame, refresh_jobs: DataFrame, **sizes: int) -> DataFrame:
    """The distinct dangling references of the project's tables."""
    refs = project_references(connections, job_attempts)
    return dangling(refs, project_parents(entities, refresh_jobs), **sizes).drop("probe").distinct()
