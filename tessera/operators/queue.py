"""The job queue: counts, order, state machine, recovery, retention, admission and progress.

events stands for the queue's rows and for its event log: event_id is the insertion order, event_type a status
(plans.standin) or an event of the state machine (event_name below), user_id a job, value a progress figure.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import planning as P
from tessera.plans.standin import EVENTS, JOBS, STATUSES, jobs, status_events, table

c = F.col
#: What an event of the table stands for; some ids stand for the rarer events.
EVENT_OF = {"click": "running", "error": "fail", "purchase": "complete", "signup": "cancel", "view": "retry"}
RARE = (("signup", 7, "clear"), ("click", 13, "recover"), ("purchase", 11, "cancel_all"), ("error", 5, "progress"))
#: (event, states it applies to, state after it). Everything else leaves the state as it is.
TRANSITIONS = (
    ("running", ("pending",), "running"),
    ("complete", ("running",), "completed"),
    ("fail", ("pending", "running"), "failed"),
    ("cancel", ("pending", "running", "cancelled"), "cancelled"),
    ("cancel_all", ("pending", "running"), "cancelled"),
    ("retry", ("failed", "cancelled"), "pending"),
    ("recover", ("running",), "pending"),
    ("clear", ("completed", "failed", "cancelled"), "removed"),
)
RETRIES = 2  # a failed run is queued again so often
MESSAGE = 200
LONG_LOG = 1 << 16
RING = 2000
SNAPSHOT_MS = 400


def event_name(kind: Column, number: Column) -> Column:
    out = P.lookup(EVENT_OF, kind)
    for source, every, name in RARE:
        out = F.when((kind == source) & (number % every == 0), name).otherwise(out)
    return out


def next_status(status: Column, event: Column) -> Column:
    out = status
    for name, states, after in TRANSITIONS:
        out = F.when((event == name) & status.isin(*states), after).otherwise(out)
    return out


def job_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of all statuses, those without rows included."""
    every = spark.range(len(STATUSES) + 1).select(F.element_at(F.array(*map(F.lit, (*STATUSES, "retry_wait"))), (c("id") + 1).cast("int")).alias("status"))
    counts = status_events(spark, sf_dir).groupBy("status").count()
    return every.join(counts, "status", "left").select("status", F.coalesce("count", F.lit(0).cast("long")).alias("n"))


def queue_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pending (or running), completed and all rows, the share that is done, and whether work is outstanding."""
    e = status_events(spark, sf_dir)
    agg = e.agg(F.count_if(c("status").isin("pending", "running")).alias("pending"), F.count_if(c("status") == "completed").alias("completed"), F.count("*").alias("total"))
    return agg.select("pending", "completed", "total", F.round(c("completed") / F.greatest(c("total"), F.lit(1)), 6).alias("done_ratio"), (c("pending") > 0).alias("outstanding"))


def queue_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pass over four groups; what is neither running, pending nor done counts as failed."""
    group = F.when(c("status") == "running", "running").when(c("status") == "pending", "pending").when(c("status") == "completed", "done").otherwise("failed")
    return status_events(spark, sf_dir).groupBy(group.alias("bucket")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


def pending_fifo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status_events(spark, sf_dir).where("status = 'pending'").orderBy("event_id").limit(128).select("event_id", "user_id")


def recent_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status_events(spark, sf_dir).orderBy(F.desc("event_id")).limit(8).select("event_id", "status")


def log_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest entries that a bounded log keeps, newest first by number, with their level."""
    level = F.when(c("event_type") == "error", "E").when(c("event_type") == "signup", "W").when(c("event_type") == "view", "D").otherwise("I")
    kept = table(spark, sf_dir, "events").orderBy(F.desc("event_id")).limit(RING)
    return kept.select("event_id", level.alias("level"), P.clock_text(c("ts")).alias("at"))


def find_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status_events(spark, sf_dir).where("event_id = 77").limit(1).select("event_id", "user_id", "status")


def clear_finished(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays after finished rows and one id are removed."""
    kept = status_events(spark, sf_dir).where(~c("status").isin("completed", "failed", "cancelled")).where("event_id <> 12")
    return kept.select("event_id", "status")


def built_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs made lazily of addresses: the name behind the last slash, sizes unknown, an id where none is given."""
    p = table(spark, sf_dir, "pages")
    return p.select(
        F.coalesce(F.nullif(F.when(c("page_id") % 3 == 0, "").otherwise(c("page_id").cast("string")), F.lit("")), F.md5("url")).alias("id"),
        P.last_segment(c("url")).alias("name"), F.lit("pending").alias("status"), F.lit(0).alias("w"), F.lit(0).alias("h"),
    )


def recovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queue as it is loaded after a crash: running rows wait again, their start and progress reset."""
    e = status_events(spark, sf_dir)
    running = c("status") == "running"
    return e.select("event_id", F.when(running, "pending").otherwise(c("status")).alias("status"), F.when(running, 0.0).otherwise(c("value")).alias("progress"), F.when(~running, c("ts")).alias("started"))


def _start(status: str = "pending", retries: int = 0, fresh: bool = False) -> Column:
    """A job's state. Null fields have not been written; a fresh job has all of them."""
    none = lambda v, t: F.lit(v if fresh else None).cast(t)
    return F.struct(
        F.lit(status).alias("status"), F.lit(retries).alias("retries"), F.lit(0).alias("applied"), F.lit(0).alias("events"), none(0.0, "double").alias("progress"),
        none(0, "long").alias("started"), none(0, "long").alias("finished"), none("", "string").alias("error"), none("", "string").alias("output"),
    )


def _step(a: Column, e: Column, auto: bool) -> Column:
    """A state after an event (event, at, value, text). ``auto``: a failed run is queued again while it has retries left."""
    event, before = e["event"], a["status"]
    again = (event == "fail") & before.isin("pending", "running") & (a["retries"] < RETRIES) if auto else F.lit(False)
    after = F.when(again, "pending").otherwise(next_status(before, event))
    # a cancelled job that is cancelled again counts as applied: its end is written anew
    hit = (after != before) | ((event == "cancel") & (before == "cancelled")) | again
    on = lambda name: hit & (event == name)
    ended = on("complete") | on("fail") | on("cancel") | on("cancel_all")
    requeued = on("retry") | again
    known = before != "removed"
    progress = F.when(on("running") | requeued | on("recover"), 0.0).when(on("complete"), 1.0).when((event == "progress") & known, F.greatest(F.lit(0.0), F.least(F.lit(1.0), e["value"])))
    return F.struct(
        after.alias("status"), (a["retries"] + requeued.cast("int")).alias("retries"), (a["applied"] + hit.cast("int")).alias("applied"), (a["events"] + 1).alias("events"),
        F.coalesce(progress, a["progress"]).alias("progress"), F.when(on("running"), e["at"]).when(on("recover"), 0).otherwise(a["started"]).alias("started"),
        F.when(requeued, 0).when(ended, e["at"]).otherwise(a["finished"]).alias("finished"),
        F.when(requeued, "").when(on("fail"), F.substring(e["text"], 1, MESSAGE)).otherwise(a["error"]).alias("error"),
        F.when(on("complete"), e["text"]).otherwise(a["output"]).alias("output"),
    )


def folded(events: DataFrame, auto: bool = False, long_log: int = LONG_LOG) -> DataFrame:
    """The state of every job (user_id) after its events (event_id, user_id, event, at, value, text), in order of event_id.

    A job's log is folded in one array. Logs of over ``long_log`` events are cut into stretches of so many ids: each
    stretch becomes a map from every state before it to the state after it, and the few stretches of a job are chained,
    so that no task holds a long log. Events of unknown name change nothing but the number of events.
    """
    states = ("pending", "running", "completed", "failed", "cancelled")
    left = range(RETRIES + 1) if auto else range(1)
    counts = events.groupBy("user_id").agg(F.count("*").alias("n")).where(c("n") > long_log).select(c("user_id").alias("long_id"))
    cut = events.join(counts, events["user_id"].eqNullSafe(c("long_id")), "left")
    cut = cut.withColumn("part", F.when(c("long_id").isNotNull(), F.floor(c("event_id") / long_log)).otherwise(-1))
    logs = cut.groupBy("user_id", "part").agg(F.array_sort(F.collect_list(F.struct("event_id", "event", "at", "value", "text"))).alias("log"))
    starts = F.when(c("part") == -1, F.array(_start(fresh=True))).otherwise(F.array(*[_start(s, r) for s in states for r in left]))
    run = F.transform(starts, lambda s: F.aggregate("log", s, lambda a, e: _step(a, e, auto)))
    parts = logs.select("user_id", F.struct("part", run.alias("ends")).alias("p")).groupBy("user_id").agg(F.array_sort(F.collect_list("p")).alias("parts"))

    def chained(a: Column, p: Column) -> Column:
        place = F.array_position(F.array(*map(F.lit, states)), a["status"]).cast("int") - 1
        held = F.least(a["retries"], F.lit(len(left) - 1))
        end = F.get(p["ends"], (place * len(left) + held).cast("int"))
        field = lambda name: F.coalesce(end[name], a[name]).alias(name)
        more = F.struct(
            end["status"].alias("status"), (a["retries"] + end["retries"] - held).alias("retries"), (a["applied"] + end["applied"]).alias("applied"), (a["events"] + end["events"]).alias("events"),
            *map(field, ("progress", "started", "finished", "error", "output")),
        )
        # a removed job is in no list: only its events are counted
        gone = a.withField("events", a["events"] + F.get(p["ends"], F.lit(0))["events"])
        return F.when(p["part"] == -1, F.get(p["ends"], F.lit(0))).when(place < 0, gone).otherwise(more)

    return parts.select("user_id", F.aggregate("parts", _start(fresh=True), chained).alias("s")).select("user_id", "s.*")


def job_events(events: DataFrame) -> DataFrame:
    """The driver's events as events of the state machine; value per cent stands for a progress, props for messages and outputs."""
    return events.select(
        "event_id", "user_id", event_name(c("event_type"), c("event_id")).alias("event"), F.unix_millis(c("ts").cast("timestamp")).alias("at"), (c("value") / 100).alias("value"), c("props").alias("text")
    )


def job_state_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs after all of their events: status, retries, times in milliseconds (0: none), progress, error and output."""
    return folded(job_events(table(spark, sf_dir, "events")))


def conflated_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One snapshot per interval of 400 ms with changes: the newest row and the number of changes it stands for."""
    e = status_events(spark, sf_dir).withColumn("bucket", F.floor(F.unix_millis(c("ts").cast("timestamp")) / SNAPSHOT_MS).cast("long"))
    return e.groupBy("bucket").agg(F.count("*").alias("changes"), F.max("event_id").alias("last_id"), F.max_by("status", "event_id").alias("last_status"))


def restart_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts of a user less than two minutes after the one before."""
    e = table(spark, sf_dir, "events")
    before = F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    gap = F.unix_micros(c("ts").cast("timestamp")) - F.unix_micros(before.cast("timestamp"))
    return e.select("event_id", "user_id", gap.alias("gap_us")).where("gap_us < 120000000")


def late_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress reports in any order: the last by number, the highest so far, both clamped to 0..1."""
    e = table(spark, sf_dir, "events").withColumn("p", F.greatest(F.lit(0.0), F.least(F.lit(1.0), c("value") / 100)))
    return e.groupBy("user_id").agg(F.round(F.max_by("p", "event_id"), 6).alias("last_report"), F.round(F.max("p"), 6).alias("shown"))


def throttled(reports: DataFrame) -> DataFrame:
    """(key, reports, passed) of progress reports (key, number, done, total): a report is passed on if it is at least a
    hundredth above the last one passed on, or the end; the first always is.

    The rule depends on its own output, so it is no window: reports are sorted by key and number and read as a stream, of which
    nothing but the last one passed on is kept, however long it is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = sent = None
        n = passed = 0
        for batch in batches:
            out = []
            for k, done, total in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if n == 0 or k != key:
                    if n:
                        out.append((key, n, passed))
                    key, sent, n, passed = k, -total, 0, 0
                n += 1
                if (done - sent) * 100 >= total or done >= total:
                    sent, passed = done, passed + 1
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], schema=schema)
        if n:
            yield pa.RecordBatch.from_pylist([dict(zip(names, (key, n, passed), strict=True))], schema=schema)

    names = ("key", "reports", "passed")
    schema = pa.schema([("key", pa.int64()), ("reports", pa.int32()), ("passed", pa.int32())])
    ordered = reports.select("key", "number", "done", "total").repartition("key").sortWithinPartitions("key", "number")
    return ordered.mapInArrow(run, "key long, reports int, passed int")


def throttled_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running sums of value per user stand for the progress of a job, of the user's whole sum."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.floor(c("value") * 100).cast("long").alias("v"))
    w = Window.partitionBy("user_id")
    done = F.sum("v").over(w.orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0))
    reports = e.select(c("user_id").alias("key"), c("event_id").alias("number"), done.alias("done"), F.sum("v").over(w).alias("total")).where("total > 0")
    return throttled(reports).select(c("key").alias("user_id"), "reports", "passed")


HEAP_MB = 1024


def admitted(waiting: DataFrame, workers: int, budget: int, held: int = 0) -> DataFrame:
    """Jobs (id, peak) of one queue that may start now, in order: at most ``workers``, while the running sum of peaks and what
    active workers ``held`` stays in ``budget``. The first that does not fit holds up all behind it. Only the first ``workers`` rows are
    ordered, so the queue's length does not matter."""
    first = waiting.orderBy("id").limit(workers)
    w = Window.orderBy("id").rowsBetween(Window.unboundedPreceding, 0)  # a handful of rows
    rows = first.select("id", "peak", (F.sum("peak").over(w) + held).alias("held"), F.row_number().over(w).alias("place"))
    return rows.where(c("held") <= budget)


def admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first round of the scheduler for every profile, and for its start, when one worker runs whatever the profile."""
    j = jobs(spark, sf_dir).select("id", P.estimate_peak_mb(c("w"), c("h"), c("target"), F.lit(256)).alias("peak"))
    cases = [("soft start", 1), *P.WORKERS.items()]
    rounds = [admitted(j, n, HEAP_MB * 7 // 10).select(F.lit(name).alias("profile"), "id", "peak", "held", "place") for name, n in cases]
    return reduce(DataFrame.unionByName, rounds)


def auto_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs whose failed runs are queued again while their retry count is below two; retries by hand count as well."""
    return folded(job_events(table(spark, sf_dir, "events")), auto=True).select("user_id", "status", "retries", "applied", "error")


def replaced(jobs: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Jobs with the rows of ``new`` (unique by key, same columns) in place of theirs; keys that no job has are ignored."""
    columns = [x for x in jobs.columns if x != key]
    side = new.select(key, F.struct(*columns).alias("_new"))
    return jobs.join(side, key, "left").select(key, *[F.when(c("_new").isNotNull(), c("_new")[x]).otherwise(c(x)).alias(x) for x in columns])


def with_meta(jobs: DataFrame, meta: DataFrame, key: str = "id") -> DataFrame:
    """Jobs with w, h and size from ``meta`` (unique by key) where it has the job; nothing else changes."""
    side = meta.select(key, F.struct("w", "h", "size").alias("_meta"))
    joined = jobs.join(side, key, "left")
    return joined.select(*[F.when(c("_meta").isNotNull(), c("_meta")[x]).otherwise(c(x)).alias(x) if x in ("w", "h", "size") else c(x) for x in jobs.columns])


def keyed_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs after sizes that were probed later and whole rows have been written over some of them. lineitem stands for the probes."""
    j = jobs(spark, sf_dir).select("id", "w", "h", F.lit(0).cast("long").alias("size"), "fmt")
    probes = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").groupBy(c("l_partkey").alias("id"))
    probes = probes.agg(F.max(c("l_quantity").cast("int")).alias("w"), F.min(c("l_quantity").cast("int")).alias("h"), F.count("*").alias("size"))
    rows = jobs(spark, sf_dir).where("id % 5 = 2").select((c("id") * 2).alias("id"), F.lit(1).alias("w"), F.lit(2).alias("h"), c("id").cast("long").alias("size"), F.lit("png").alias("fmt"))
    return replaced(with_meta(j, probes), rows)


QUERIES = {
    "job_status_counts": job_status_counts, "queue_counters": queue_counters, "queue_groups": queue_groups, "pending_fifo": pending_fifo, "recent_last": recent_last,
    "log_ring": log_ring, "find_one": find_one, "clear_finished": clear_finished, "built_jobs": built_jobs, "recovered": recovered, "job_state_fold": job_state_fold,
    "conflated_snapshots": conflated_snapshots, "restart_gaps": restart_gaps, "late_progress": late_progress, "throttled_progress": throttled_progress,
    "admission": admission, "auto_retry": auto_retry, "keyed_updates": keyed_updates,
}

_NAMED = """CASE WHEN event_type = 'signup' AND event_id % 7 = 0 THEN 'clear' WHEN event_type = 'click' AND event_id % 13 = 0 THEN 'recover' WHEN event_type = 'purchase' AND event_id % 11 = 0 THEN 'cancel_all'
  WHEN event_type = 'error' AND event_id % 5 = 0 THEN 'progress' WHEN event_type = 'click' THEN 'run' WHEN event_type = 'error' THEN 'fail' WHEN event_type = 'purchase' THEN 'complete' WHEN event_type = 'signup' THEN 'cancel' WHEN event_type = 'view' THEN 'retry' END"""


def _fold_sql(auto: bool) -> str:
    """A recursive query: in each round one event of every job, first what happens (act), then what it writes."""
    again = "WHEN e.event = 'fail' AND s.status IN ('pending', 'running') AND s.retries < 2 THEN 'again' " if auto else ""
    act = f"""CASE {again}WHEN e.event = 'run' AND s.status = 'pending' OR e.event = 'complete' AND s.status = 'running' OR e.event = 'fail' AND s.status IN ('pending', 'running')
  OR e.event = 'cancel' AND s.status NOT IN ('completed', 'failed', 'removed') OR e.event = 'cancel_all' AND s.status IN ('pending', 'running') OR e.event = 'retry' AND s.status IN ('failed', 'cancelled')
  OR e.event = 'recover' AND s.status = 'running' OR e.event = 'clear' AND s.status IN ('completed', 'failed', 'cancelled') OR e.event = 'progress' AND s.status <> 'removed' THEN e.event ELSE 'none' END"""
    return f"""WITH RECURSIVE e AS (SELECT user_id, {_NAMED} AS event, epoch_us(ts) // 1000 AS ms, value / 100 AS value, props, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, count(*) OVER (PARTITION BY user_id) AS total FROM events),
s AS (SELECT DISTINCT user_id, 0::BIGINT AS n, total, 'pending' AS status, 0 AS retries, 0 AS applied, 0.0::DOUBLE AS progress, 0::BIGINT AS started, 0::BIGINT AS finished, '' AS error, '' AS output FROM e
  UNION ALL SELECT user_id, n, total, CASE act WHEN 'run' THEN 'running' WHEN 'complete' THEN 'completed' WHEN 'fail' THEN 'failed' WHEN 'cancel' THEN 'cancelled' WHEN 'cancel_all' THEN 'cancelled' WHEN 'retry' THEN 'pending'
      WHEN 'again' THEN 'pending' WHEN 'recover' THEN 'pending' WHEN 'clear' THEN 'removed' ELSE status END, retries + (act IN ('retry', 'again'))::INT, applied + (act NOT IN ('none', 'progress'))::INT,
    CASE act WHEN 'run' THEN 0 WHEN 'retry' THEN 0 WHEN 'again' THEN 0 WHEN 'recover' THEN 0 WHEN 'complete' THEN 1 WHEN 'progress' THEN greatest(0, least(1, value)) ELSE progress END,
    CASE act WHEN 'run' THEN ms WHEN 'recover' THEN 0 ELSE started END, CASE WHEN act IN ('retry', 'again') THEN 0 WHEN act IN ('complete', 'fail', 'cancel', 'cancel_all') THEN ms ELSE finished END,
    CASE WHEN act IN ('retry', 'again') THEN '' WHEN act = 'fail' THEN substr(props, 1, 200) ELSE error END, CASE act WHEN 'complete' THEN props ELSE output END
  FROM (SELECT e.user_id, e.n, s.total, s.status, s.retries, s.applied, s.progress, s.started, s.finished, s.error, s.output, e.ms, e.value, e.props, {act} AS act FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1))
"""


ORACLE_SQL = {
    "job_status_counts": f"WITH {EVENTS} SELECT v.status, count(ev.status) AS n FROM (VALUES ('pending'), ('running'), ('completed'), ('failed'), ('cancelled'), ('retry_wait')) v(status) LEFT JOIN ev ON ev.status = v.status GROUP BY 1",
    "queue_counters": f"WITH {EVENTS}, a AS (SELECT count(*) FILTER (status IN ('pending', 'running')) AS pending, count(*) FILTER (status = 'completed') AS completed, count(*) AS total FROM ev) SELECT *, round(completed::DOUBLE / greatest(total, 1), 6) AS done_ratio, pending > 0 AS outstanding FROM a",
    "queue_groups": f"WITH {EVENTS} SELECT CASE status WHEN 'running' THEN 'running' WHEN 'pending' THEN 'pending' WHEN 'completed' THEN 'done' ELSE 'failed' END AS bucket, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM ev GROUP BY 1",
    "pending_fifo": "SELECT event_id, user_id FROM events WHERE event_type = 'click' ORDER BY event_id LIMIT 128",
    "recent_last": f"WITH {EVENTS} SELECT event_id, status FROM ev ORDER BY event_id DESC LIMIT 8",
    "log_ring": "SELECT event_id, CASE event_type WHEN 'error' THEN 'E' WHEN 'signup' THEN 'W' WHEN 'view' THEN 'D' ELSE 'I' END AS level, strftime(ts, '%H:%M:%S.%g') AS at FROM events ORDER BY event_id DESC LIMIT 2000",
    "find_one": f"WITH {EVENTS} SELECT event_id, user_id, status FROM ev WHERE event_id = 77",
    "clear_finished": f"WITH {EVENTS} SELECT event_id, status FROM ev WHERE status IN ('pending', 'running') AND event_id <> 12",
    "built_jobs": "SELECT CASE WHEN page_id % 3 = 0 THEN md5(url) ELSE page_id::VARCHAR END AS id, split_part(url, '/', -1) AS name, 'pending' AS status, 0 AS w, 0 AS h FROM pages",
    "recovered": f"WITH {EVENTS} SELECT event_id, CASE status WHEN 'running' THEN 'pending' ELSE status END AS status, CASE status WHEN 'running' THEN 0.0 ELSE value END::DOUBLE AS progress, CASE WHEN status <> 'running' THEN ts END AS started FROM ev",
    "job_state_fold": _fold_sql(False) + "SELECT user_id, status, retries, applied, n::INT AS events, progress, started, finished, error, output FROM s WHERE n = total",
    "conflated_snapshots": f"WITH {EVENTS} SELECT epoch_us(ts) // 400000 AS bucket, count(*) AS changes, max(event_id) AS last_id, arg_max(status, event_id) AS last_status FROM ev GROUP BY 1",
    "restart_gaps": "WITH g AS (SELECT event_id, user_id, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap_us FROM events) SELECT * FROM g WHERE gap_us < 120000000",
    "late_progress": "WITH p AS (SELECT user_id, event_id, greatest(0.0::DOUBLE, least(1.0::DOUBLE, value / 100)) AS p FROM events) SELECT user_id, round(arg_max(p, event_id), 6) AS last_report, round(max(p), 6) AS shown FROM p GROUP BY 1",
    "throttled_progress": """WITH RECURSIVE e AS (SELECT user_id, floor(value * 100)::BIGINT AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, count(*) OVER (PARTITION BY user_id) AS reports,
  (sum(floor(value * 100)::BIGINT) OVER (PARTITION BY user_id))::BIGINT AS total FROM events),
s AS (SELECT DISTINCT user_id, 0::BIGINT AS n, reports, total, 0::BIGINT AS now, -total AS sent, 0 AS passed FROM e WHERE total > 0
  UNION ALL SELECT s.user_id, e.n, s.reports, s.total, now + v, CASE WHEN 100 * (now + v - sent) >= s.total OR now + v = s.total THEN now + v ELSE sent END,
    passed + (100 * (now + v - sent) >= s.total OR now + v = s.total)::INT FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1)
SELECT user_id, reports::INT AS reports, passed FROM s WHERE n = reports""",
    "admission": f"""WITH {JOBS}, p AS (SELECT id, (CASE WHEN w::BIGINT * target * h * target * 4 > 188743680 THEN 160 ELSE 91 + w::BIGINT * target * h * target * 4 // 1048576 END)::BIGINT AS peak FROM jobs),
r AS (SELECT id, peak, (sum(peak) OVER (ORDER BY id))::BIGINT AS held, (row_number() OVER (ORDER BY id))::INT AS place FROM p)
SELECT profile, id, peak, held, place FROM r, (VALUES ('soft start', 1), ('saver', 1), ('balanced', 2), ('performance', 3), ('ultra', 4)) v(profile, n) WHERE held <= 716 AND place <= n""",
    "auto_retry": _fold_sql(True) + "SELECT user_id, status, retries, applied, error FROM s WHERE n = total",
    "keyed_updates": f"""WITH {JOBS}, m AS (SELECT l_partkey AS id, max(l_quantity)::INT AS w, min(l_quantity)::INT AS h, count(*) AS size FROM lineitem WHERE l_linenumber = 1 GROUP BY 1)
SELECT j.id, CASE WHEN n.id IS NOT NULL THEN 1 ELSE coalesce(m.w, j.w) END::INT AS w, CASE WHEN n.id IS NOT NULL THEN 2 ELSE coalesce(m.h, j.h) END::INT AS h, coalesce(n.id, m.size, 0)::BIGINT AS size, CASE WHEN n.id IS NOT NULL THEN 'png' ELSE j.fmt END AS fmt
FROM jobs j LEFT JOIN m ON m.id = j.id LEFT JOIN jobs n ON n.id * 2 = j.id AND n.id % 5 = 2""",
}
