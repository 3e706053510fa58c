"""Queue, events and retention as Structured Streaming, with the batch forms they must agree with."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: From which status a job may go where.
MOVES = {"queued": ("running", "failed"), "running": ("completed", "failed", "queued"), "completed": (), "failed": ("queued",)}


def consume(queue: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, seconds: float | None = None) -> StreamingQuery:
    """The queue's consumer loop: each micro-batch is handed to work once (files a trigger bound its size); without seconds it ends when the queue is empty."""
    writer = queue.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=f"{seconds} seconds") if seconds else writer.trigger(availableNow=True)).start()


def enqueue(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def latest_status(events: DataFrame) -> DataFrame:
    """Each job's last status by time: the batch form of the state machine for orderly logs."""
    return events.groupBy("job_id").agg(F.max_by("status", F.struct("ts", "seq")).alias("status"), F.max("ts").alias("ts"))


def fold_status(events: list[tuple[str, str]]) -> str:
    """Status after moves in order; a move that isn't allowed is ignored."""
    status = "queued"
    for _, to in events:
        if to in MOVES[status]:
            status = to
    return status


def status_stream(events: DataFrame) -> DataFrame:
    """(job_id, status, moves) whenever a job moves, kept as state a job. Input (job_id, ts, status), in order within a batch."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, moves = state.get if state.exists else ("queued", 0)
        rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
        for to in rows["status"]:
            if to in MOVES[status]:
                status, moves = to, moves + 1
        state.update((status, moves))
        yield pd.DataFrame({"job_id": [key[0]], "status": [status], "moves": [moves]})

    return events.groupBy("job_id").applyInPandasWithState(step, "job_id long, status string, moves long", "status string, moves long", "update", GroupStateTimeout.NoTimeout)


def recover(jobs: DataFrame) -> DataFrame:
    """Jobs that ran when the process stopped go back to the queue."""
    return jobs.withColumn("status", F.when(F.col("status") == "running", "queued").otherwise(F.col("status")))


def distinct_events(events: DataFrame, key: str, time: str, within: str = "2 seconds") -> DataFrame:
    """Events without repeats of a key inside the watermark: the streaming approximation of operators.folds.event_gap_filter."""
    return events.withWatermark(time, within).dropDuplicatesWithinWatermark([key])


def windowed_counts(events: DataFrame, time: str, key: str, late: str = "10 minutes", size: str = "5 minutes", slide: str | None = None) -> DataFrame:
    w = F.window(time, size, slide) if slide else F.window(time, size)
    return events.withWatermark(time, late).groupBy(w.alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("began"), key, "n")


def sessions(events: DataFrame, time: str, key: str, gap: str = "6 hours", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark(time, late).groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("began"), "n")


def since(events: DataFrame, cursor: tuple, limit: int) -> DataFrame:
    """A poll: the first `limit` events (ts, event_id) after the cursor (ts, event_id), oldest first; events of one instant follow their ids. The last row is the next cursor."""
    ts, event_id = F.lit(cursor[0]), F.lit(cursor[1])
    return events.where((F.col("ts") > ts) | ((F.col("ts") == ts) & (F.col("event_id") > event_id))).orderBy("ts", "event_id").limit(limit)


def next_poll(statuses: DataFrame, busy: float = 1.0, idle: float = 4.0) -> DataFrame:
    """(seconds) until a client asks again: soon while any job runs."""
    return statuses.agg(F.when(F.coalesce(F.bool_or(F.col("status").isin("running", "queued")), F.lit(False)), busy).otherwise(idle).alias("seconds"))


def orphans(workers: DataFrame, owners: DataFrame, key: str, fingerprint: str) -> DataFrame:
    """Workers (key, fingerprint) that no living owner of the same fingerprint stands behind: a reused number isn't an owner."""
    return workers.join(owners.select(key, fingerprint).distinct(), [key, fingerprint], "left_anti")
