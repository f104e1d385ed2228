"""What changed between consecutive full snapshots: full outer join on the key, comparing canonical row hashes.

Defined results: a snapshot is a run that didn't fail; runs without a start time take no part; rows without their run
take no part. Nulls in a key column are a value of their own. Of several rows of one key in one run the latest
ingested_at counts; on a tie the largest canonical values, so repeated rows change nothing. Empty tables give no rows.
A run with no rows is a snapshot all the same: everything before it is removed. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.text import key as text_key

NONE = "\u0000"


def run_order(runs: DataFrame, scope: str = "project_id") -> DataFrame:
    """(scope, run_id, seq): the good runs of each project, numbered in order of started_at."""
    good = runs.where((F.lower(F.trim(F.coalesce("status", F.lit("")))) != "failed") & F.col("started_at").isNotNull())
    good = good.select(F.col(scope).alias("scope"), "run_id", "started_at").dropDuplicates(["scope", "run_id"])
    return good.select("scope", "run_id", F.row_number().over(Window.partitionBy("scope").orderBy("started_at", "run_id")).alias("seq"))


def changes(rows: DataFrame, runs: DataFrame, keys: list[str], tracked: dict[str, Column], scope: str = "project_id") -> DataFrame:
    """One row per added, removed or modified key of each pair of consecutive snapshots.

    tracked: name -> canonical value; columns before and after hold all of them, changed_fields the names that differ.
    Runs are numbered, so the earlier side of a pair is the same table with its number raised by one. The rows are
    shuffled once for the latest copy of a key; that layout also is the later side of the join, and both sides reuse
    it, so only the earlier side moves again. What belongs to no pair (before the first, after the last run) falls out
    when the changed rows get their run ids.
    """
    names = sorted(tracked)
    k = [F.coalesce(F.col(c).cast("string"), F.lit(NONE)).alias(c) for c in keys]
    narrow = rows.select(F.col(scope).alias("scope"), "run_id", *k, F.struct(F.col("ingested_at"), *(tracked[n].alias(n) for n in names)).alias("v"))
    order = run_order(runs, scope)
    latest = narrow.join(order, ["scope", "run_id"]).groupBy("scope", "seq", *keys).agg(F.max("v").alias("v"))
    value, row_hash = F.struct(*(F.col(f"v.{n}").alias(n) for n in names)), F.xxhash64(*(F.col(f"v.{n}") for n in names))
    after = latest.select("scope", F.col("seq").alias("to_seq"), *keys, value.alias("after"), row_hash.alias("hash_a"))
    before = latest.select("scope", (F.col("seq") + 1).alias("to_seq"), *keys, value.alias("before"), row_hash.alias("hash_b"))
    both = after.join(before, ["scope", "to_seq", *keys], "full_outer")
    change = F.when(F.col("hash_b").isNull(), "added").when(F.col("hash_a").isNull(), "removed").when(F.col("hash_a") != F.col("hash_b"), "modified")
    differing = F.array_join(F.array_compact(F.array(*(F.when(~F.col(f"before.{n}").eqNullSafe(F.col(f"after.{n}")), F.lit(n)) for n in names))), ",")
    pairs = order.select("scope", F.col("seq").alias("to_seq"), F.col("run_id").alias("to_run_id")).join(
        order.select("scope", (F.col("seq") + 1).alias("to_seq"), F.col("run_id").alias("from_run_id")), ["scope", "to_seq"])
    return (
        both.withColumn("change", change)
        .where(F.col("change").isNotNull())
        .join(pairs, ["scope", "to_seq"])
        .select(
            F.col("scope").alias(scope),
            "from_run_id",
            "to_run_id",
            *(F.when(F.col(c) != NONE, F.col(c)).alias(c) for c in keys),
            "change",
            F.when(F.col("change") == "modified", differing).otherwise(F.lit("")).alias("changed_fields"),
            "before",
            "after",
        )
    )


FIELD_KEY = ["service", "endpoint_id", "location", "name"]


def contract_changes(fields: DataFrame, runs: DataFrame) -> DataFrame:
    """Changes of contract fields: type without case and outer blanks (absent = blank), absent flags are false."""
    tracked = {
        "type": F.coalesce(text_key("type"), F.lit("")),
        "required": F.coalesce(F.col("required"), F.lit(False)),
        "nullable": F.coalesce(F.col("nullable"), F.lit(False)),
    }
    return changes(fields, runs, FIELD_KEY, tracked)
