"""The refresh-job queue as batch operators: enqueue checks, claims, transitions, retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Allowed transitions; fixed values.
TRANSITIONS = {"queued": ("running", "cancelled"), "running": ("succeeded", "failed", "cancelled", "interrupted"), "failed": ("queued",), "interrupted": ("queued",), "cancelled": (), "succeeded": ()}
MAX_BACKOFF = 6


def enqueue_outcome(jobs: DataFrame, key: list[str]) -> DataFrame:
    """Per delivery key: accepted once, repeated with the same digest, or conflicting digests."""
    return jobs.groupBy(*key).agg(
        F.min("job_id").alias("job_id"), F.count("*").alias("deliveries"), F.when(F.countDistinct(F.coalesce("payload_digest", F.lit(""))) > 1, "conflict").when(F.count("*") > 1, "repeated").otherwise("accepted").alias("outcome"))


def claimable(jobs: DataFrame, lane: tuple[str, ...] = ("project_id",)) -> DataFrame:
    """The next due queued job of each lane that has none running, the earliest first."""
    busy = jobs.where("status = 'running'").select(*lane).distinct()
    q = jobs.where("status = 'queued' and coalesce(cancel_requested, false) = false").join(busy, list(lane), "left_anti")
    return q.groupBy(*lane).agg(F.min(F.struct("not_before", "created_at", "job_id")).alias("j")).select(*lane, "j.job_id", "j.not_before")


def retry_at(attempts: DataFrame, jobs: DataFrame) -> DataFrame:
    """Failed jobs with attempts left and when they may run again: 2^min(attempts, 6) seconds after the last one ended."""
    a = attempts.groupBy("job_id").agg(F.count("*").alias("n"), F.max("finished_at").alias("ended"))
    j = jobs.where("status in ('failed', 'interrupted')").withColumn("job_id", F.lower("job_id")).join(a, "job_id")
    wait = F.pow(F.lit(2), F.least(F.col("n"), F.lit(MAX_BACKOFF))).cast("int")
    return j.where(F.col("n") < F.col("max_attempts")).select("job_id", F.col("n").alias("attempts"), (F.unix_micros("ended") + wait.cast("bigint") * 1_000_000).alias("retry_us"))


def recover(jobs: DataFrame) -> DataFrame:
    """After a crash: running jobs become interrupted, those asked to stop become cancelled."""
    s = F.when(F.coalesce("cancel_requested", F.lit(False)) & F.col("status").isin("running", "queued"), "cancelled").when(F.col("status") == "running", "interrupted").otherwise(F.col("status"))
    return jobs.withColumn("status", s)


def allowed(now: str, then: str):
    """Whether the state machine has this transition."""
    pairs = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, bs in TRANSITIONS.items() for b in bs]
    return F.array_contains(F.array(*pairs), F.struct(F.col(now).alias("a"), F.col(then).alias("b")))


def keep_last(df: DataFrame, group: str, order: list, n: int) -> DataFrame:
    """Ring buffer: the last n rows of each group with their sequence number from the newest."""
    return df.withColumn("age", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("age") <= n)
