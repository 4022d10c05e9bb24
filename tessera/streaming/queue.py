"""The queue as streams: snapshots, the state machine per job, row assembly, durable snapshots.

Event logs enter as in the driver's events table. State is kept per key; the rules are those of operators.queue, so
batch and stream agree.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.operators.queue import MESSAGE, TRANSITIONS, job_events
from tessera.operators.queue import ORACLE_SQL as BATCH_SQL
from tessera.plans.standin import EVENT_STATUS
from tessera.plans.shared import shared_folder
from tessera.plans.standin import EVENTS as EVENTS_SQL
from tessera.sources.images import publish, published

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
STATE = "status string, retries int, applied int, events int, progress double, started long, finished long, error string, output string"
FRESH = ("pending", 0, 0, 0, 0.0, 0, 0, "", "")


def event_stream(spark: SparkSession, folder: str, files: int = 4) -> DataFrame:
    """events.parquet below a folder as a stream, so many files a trigger at most."""
    return spark.readStream.schema(EVENTS).option("pathGlobFilter", "events*.parquet").option("maxFilesPerTrigger", files).parquet(folder)


def next_state(status: str, event: str) -> str:
    for name, states, after in TRANSITIONS:
        if event == name and status in states:
            return after
    return status


def status_counts(events: DataFrame) -> DataFrame:
    """Counts per status: a full snapshot each trigger in complete mode, which is how changes are conflated."""
    pairs = [F.lit(x) for kv in EVENT_STATUS.items() for x in kv]
    return events.groupBy(F.coalesce(F.create_map(*pairs)[F.col("event_type")], F.lit("retry_wait")).alias("status")).count()


def stepped(state: tuple, event: str | None, at: int, value: float, text: str | None) -> tuple:
    """A job's state (STATE) after one event."""
    status, retries, applied, events, progress, started, finished, error, output = state
    after = next_state(status, event or "")
    hit = after != status or (event == "cancel" and status == "cancelled")
    if event == "progress" and status != "removed":
        progress = min(1.0, max(0.0, value))
    if hit:
        if event in ("running", "retry", "recover"):
            progress = 0.0
        if event in ("running", "recover"):
            started = at if event == "running" else 0
        if event == "retry":
            retries, finished, error = retries + 1, 0, ""
        if event in ("complete", "fail", "cancel", "cancel_all"):
            finished = at
        if event == "complete":
            progress, output = 1.0, text
        if event == "fail":
            error = (text or "")[:MESSAGE]
    return after, retries, applied + hit, events + 1, progress, started, finished, error, output


def job_states(events: DataFrame) -> DataFrame:
    """The state machine per job, its newest state whenever it gets events. Events of a trigger are taken by number."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = tuple(state.get) if state.exists else FRESH
        rows = pd.concat(list(batches)).sort_values("event_id")
        for event, at, value, text in zip(rows["event"], rows["at"], rows["value"], rows["text"], strict=True):
            now = stepped(now, event, int(at), float(value), text)
        state.update(now)
        yield pd.DataFrame([(key[0], *now)], columns=["user_id", *(f.split()[0] for f in STATE.split(", "))])

    return job_events(events).groupBy("user_id").applyInPandasWithState(run, f"user_id long, {STATE}", STATE, "update", GroupStateTimeout.NoTimeout)


def assembled_rows(parts: DataFrame) -> DataFrame:
    """Image rows from parts (image, y, x, width, data): a row leaves once full, in order of y. Parts may come in any order and as
    late as they like: rows behind a gap wait for it, none is given up. Parts of rows that have left are ignored."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        due, width, ys, xs, held = state.get if state.exists else (0, 0, [], [], [])
        waiting: dict[int, dict[int, bytes]] = {}
        for y, x, data in zip(ys, xs, held, strict=True):
            waiting.setdefault(y, {})[x] = bytes(data)
        for pdf in batches:
            for y, x, width, data in zip(pdf["y"], pdf["x"], pdf["width"], pdf["data"], strict=True):  # noqa: B007
                if y >= due:
                    waiting.setdefault(int(y), {})[int(x)] = bytes(data)
        out = []
        while (row := waiting.get(due)) is not None and sum(map(len, row.values())) >= width * 3:
            out.append((key[0], due, b"".join(row[x] for x in sorted(row))))
            del waiting[due]
            due += 1
        flat = [(y, x, d) for y, row in waiting.items() for x, d in row.items()]
        state.update((due, int(width), [f[0] for f in flat], [f[1] for f in flat], [f[2] for f in flat]))
        yield pd.DataFrame(out, columns=["image", "y", "rgb"])

    return parts.groupBy("image").applyInPandasWithState(
        run, "image long, y int, rgb binary", "due int, width int, ys array<int>, xs array<int>, held array<binary>", "append", GroupStateTimeout.NoTimeout
    )


def drained(stream: DataFrame, mode: str, checkpoint: str | None = None) -> DataFrame:
    """All that a stream gives until its input is used up, as a table in the shared folder, beside the stream's checkpoint.

    Each trigger writes a folder of its own number, so one that is repeated after a failure replaces it. In complete mode
    the last folder is the result.
    """
    spark = stream.sparkSession
    place = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    last: list[int] = []

    def keep(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{place}/rows/trigger={number}")
        last.append(number)

    writer = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", checkpoint or f"{place}/checkpoint")
    writer.foreachBatch(keep).start().awaitTermination()
    if not last:
        return spark.createDataFrame([], stream.schema)
    path = f"{place}/rows/trigger={last[-1]}" if mode == "complete" else f"{place}/rows"
    return spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(path)


def durable_snapshots(states: DataFrame, path: str, checkpoint: str, interval: str | None = "30 seconds"):
    """A running query that publishes the newest state of all jobs at ``path`` every ``interval``; without one, until the input is used up.

    ``states`` are updates of job_states. They are merged with the snapshot published before, whose readers see one of both whole.
    """
    def keep(rows: DataFrame, number: int) -> None:
        new = rows.withColumn("trigger", F.lit(number))
        old = published(rows.sparkSession, path)
        both = new if old is None else new.unionByName(old)
        newest = both.groupBy("user_id").agg(F.max_by(F.struct(*both.columns), "events").alias("s")).select("s.*")
        publish(newest, path)

    writer = states.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(keep)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def resumed(waiting: DataFrame, enabled: bool, work: Callable[[], None]) -> bool:
    """What a periodic wake-up does: work on if that is enabled and any job (status) is pending or running; whether it did."""
    outstanding = enabled and not waiting.where(F.col("status").isin("pending", "running")).limit(1).isEmpty()
    if outstanding:
        work()
    return outstanding


def stream_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drained(status_counts(event_stream(spark, sf_dir)), "complete").select("status", F.col("count").alias("n"))


def stream_job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest state of every job once the stream is drained."""
    updates = drained(job_states(event_stream(spark, sf_dir)), "update")
    return updates.groupBy("user_id").agg(F.max_by(F.struct(*updates.columns), "events").alias("s")).select("s.*")


def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: event counts per five minutes behind a watermark of ten."""
    events = event_stream(spark, sf_dir).withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", "10 minutes")
    counts = drained(events.groupBy(F.window("at", "5 minutes")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("value")), "complete")
    return counts.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "n", "value")


QUERIES = {"stream_status_counts": stream_status_counts, "stream_job_states": stream_job_states, "stream_windows": stream_windows}
ORACLE_SQL = {
    "stream_status_counts": f"WITH {EVENTS_SQL} SELECT status, count(*) AS n FROM ev GROUP BY 1",
    "stream_job_states": BATCH_SQL["job_state_fold"],
    "stream_windows": "SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS start, count(*) AS n, round(sum(value), 2) AS value FROM events GROUP BY 1",
}
