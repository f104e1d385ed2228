"""The job queue as streams: idempotent enqueue, one running job per project with retries, and the event log.

State is keyed by project and job, so it grows with the open jobs; finished ones leave it, and each command writes only its own. All
operators run with a checkpoint location and give the same result after a restart.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

COMMANDS = "project_id string, at timestamp, command string, job_id string, digest string, outcome string"
EFFECTS = "project_id string, at timestamp, job_id string, effect string, attempts int"
MAX_ATTEMPTS, MAX_BACKOFF = 3, 6


def first_deliveries(deliveries: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Deliveries(project_id, delivery_id, at, ...) once each within the lateness."""
    return deliveries.withWatermark("at", lateness).dropDuplicatesWithinWatermark(["project_id", "delivery_id"])


class Lane(StatefulProcessor):
    """One project's lane: open jobs in order of arrival, at most one running.

    Commands: enqueue (equal queued digests coalesce, an id with another digest conflicts), claim, finish (outcome
    succeeded or failed; failed goes back to the queue until its attempts are used up), cancel, recover. Jobs without a
    digest never coalesce.

    Each open job is an entry of its own in keyed state, with the queued digests and the running job beside them, so a
    command writes what it changes, however many jobs a project has open; only a claim looks through the queued ones.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.jobs = handle.getMapState("jobs", "job_id string", "digest string, status string, attempts int, due double, seq long")
        self.queued = handle.getMapState("queued", "digest string", "job_id string")
        self.lane = handle.getValueState("lane", "running string, seq long")

    def close(self) -> None:
        pass

    def _get(self, job_id: str | None):
        return self.jobs.getValue((job_id,)) if job_id is not None and self.jobs.containsKey((job_id,)) else None

    def _put(self, job_id: str, digest, status: str, attempts: int, due: float, seq: int) -> None:
        self.jobs.updateValue((job_id,), (digest, status, attempts, due, seq))
        if digest is not None and status == "queued" and not self.queued.containsKey((digest,)):
            self.queued.updateValue((digest,), (job_id,))

    def _leaves_queue(self, job_id: str, digest) -> None:
        """The digest stands for the earliest other job that waits with it, if there is one."""
        if digest is None or not self.queued.containsKey((digest,)) or self.queued.getValue((digest,))[0] != job_id:
            return
        others = [(v[4], k[0]) for k, v in self.jobs.iterator() if k[0] != job_id and v[0] == digest and v[1] == "queued"]
        if others:
            self.queued.updateValue((digest,), (min(others)[1],))
        else:
            self.queued.removeKey((digest,))

    def _claimable(self, now: float) -> str | None:
        ready = ((v[4], k[0]) for k, v in self.jobs.iterator() if v[1] == "queued" and v[3] <= now)
        return min(ready, default=(0, None))[1]

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import pandas as pd

        running, seq = self.lane.get() if self.lane.exists() else (None, 0)
        frame = pd.concat(list(rows)).sort_values(["at", "job_id", "command"], kind="stable")
        out = []

        def say(row, job_id, effect, attempts=0):
            out.append((key[0], row.at_, job_id, effect, attempts))

        for row in frame.rename(columns={"at": "at_"}).itertuples(index=False):
            own = self._get(row.job_id)
            if row.command == "enqueue" and row.job_id is not None:
                if own:
                    say(row, row.job_id, "repeated" if own[0] == row.digest else "conflict")
                elif row.digest is not None and self.queued.containsKey((row.digest,)):
                    say(row, row.job_id, "coalesced")
                else:
                    self._put(row.job_id, row.digest, "queued", 0, 0.0, seq)
                    seq += 1
                    say(row, row.job_id, "queued")
            elif row.command == "claim":
                job = None if running else self._claimable(row.at_.timestamp())
                if job:
                    digest, _, attempts, due, at = self._get(job)
                    self._leaves_queue(job, digest)
                    self._put(job, digest, "running", attempts + 1, due, at)
                    running = job
                    say(row, job, "claimed", attempts + 1)
            elif row.command == "finish" and own and own[1] == "running":
                digest, _, attempts, _, at = own
                running = None
                if row.outcome == "failed" and attempts < MAX_ATTEMPTS:
                    self._put(row.job_id, digest, "queued", attempts, row.at_.timestamp() + 2 ** min(attempts, MAX_BACKOFF), at)
                    say(row, row.job_id, "retry", attempts)
                else:
                    self.jobs.removeKey((row.job_id,))
                    say(row, row.job_id, row.outcome or "succeeded", attempts)
            elif row.command == "cancel" and own:
                if own[1] == "queued":
                    self._leaves_queue(row.job_id, own[0])
                running = None if running == row.job_id else running
                self.jobs.removeKey((row.job_id,))
                say(row, row.job_id, "cancelled", own[2])
            elif row.command == "recover" and running:
                digest, _, attempts, due, at = self._get(running)
                self._put(running, digest, "queued", attempts, due, at)
                say(row, running, "interrupted", attempts)
                running = None
        self.lane.update((running, seq))
        yield pd.DataFrame(out, columns=["project_id", "at", "job_id", "effect", "attempts"])


def lanes(commands: DataFrame) -> DataFrame:
    """Effects of a stream of queue commands, per project in order of time; keyed map state needs the RocksDB state store."""
    commands.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return commands.groupBy("project_id").transformWithStateInPandas(Lane(), EFFECTS, "Append", "None")


def event_log(events: DataFrame, path: str, checkpoint: str):
    """Appends a stream of events(run_id, sequence, ...) to a folder, exactly once per checkpoint."""

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").json(f"{path}/batch={batch}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def windowed_counts(events: DataFrame, size: str = "5 minutes", slide: str | None = None, lateness: str = "10 minutes") -> DataFrame:
    """Events per type and tumbling or sliding window; later events than the lateness are dropped. Beyond the batch operators."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withWatermark("ts", lateness).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", lateness: str = "10 minutes") -> DataFrame:
    """Sessions of each user by a gap in time. Beyond the batch operators."""
    return events.withWatermark("ts", lateness).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "user_id", "n")
