import datetime as dt
import random
import time

import numpy as np
import pytest

from tessera.operators import engine, rasters
from tessera.operators import queue as batch
from tessera.sources import images
from tessera.streaming import queue
from tessera.streaming.runner import Runner

SEQUENCES = [
    (["click", "signup", "purchase"], "cancelled", 0),
    (["click", "signup", "error"], "cancelled", 0),
    (["signup", "click"], "cancelled", 0),
    (["click", "purchase"], "completed", 0),
    (["error"], "failed", 0),
    (["click", "purchase", "signup"], "completed", 0),
    (["error", "view"], "pending", 1),
    (["signup", "view", "click"], "running", 1),
    (["purchase"], "pending", 0),
]


def test_state_machine_over_several_triggers(spark, tmp_path):
    rng = random.Random(2)
    log = []
    for user, (events, _, _) in enumerate(SEQUENCES):
        # numbers that 5, 7, 11 and 13 do not divide stand for no rarer event
        log += [(i * 5005 * 100 + 5005 * user + 1, dt.datetime(2024, 1, 1), user, e, 0.0, "") for i, e in enumerate(events)]
    for k in range(3):
        part = [r for r in log if r[0] // 500500 == k]
        rng.shuffle(part)
        spark.createDataFrame(part, queue.EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in{k}"))
    folder = tmp_path / "in"
    folder.mkdir()
    for k in range(3):  # one file a trigger, in time order
        source = next((tmp_path / f"in{k}").glob("*.parquet"))
        target = folder / f"events{k}.parquet"
        target.write_bytes(source.read_bytes())
        import os

        os.utime(target, (1_700_000_000 + k, 1_700_000_000 + k))
    got = queue.drained(queue.job_states(queue.event_stream(spark, str(folder), files=1)), "update", str(tmp_path / "ck"))
    last = {}
    for r in got.collect():
        last[r.user_id] = max(last.get(r.user_id, (-1,)), (r.events, r.status, r.retries))
    assert {u: x[1:] for u, x in last.items()} == {u: (s, n) for u, (_, s, n) in enumerate(SEQUENCES)}


#: (events, state after them): status, retries, applied, progress, started, finished, error, output. The n-th event happens at n + 1.
FIELDS = [
    (["running", "complete"], ("completed", 0, 2, 1.0, 1, 2, "", "t1")),
    (["running", "progress", "fail"], ("failed", 0, 2, 0.5, 1, 3, "t2", "")),
    (["fail", "retry", "running"], ("running", 1, 3, 0.0, 3, 0, "", "")),
    (["cancel", "cancel"], ("cancelled", 0, 2, 0.0, 0, 2, "", "")),
    (["running", "recover", "complete"], ("pending", 0, 2, 0.0, 0, 0, "", "")),
    (["running", "cancel_all", "clear", "retry", "progress"], ("removed", 0, 3, 0.0, 1, 2, "", "")),
    (["complete", "clear", "retry", None], ("pending", 0, 0, 0.0, 0, 0, "", "")),
]
#: The same with failed runs queued again twice: status, retries, error.
RETRIED = [
    (["running", "fail"], ("pending", 1, "")),
    (["fail", "fail", "fail"], ("failed", 2, "t2")),
    (["cancel", "retry", "retry", "fail", "fail"], ("failed", 2, "t4")),
]


def _log(cases):
    return [(100 * n + k, n, e, k + 1, 0.5, f"t{k}") for n, (events, _) in enumerate(cases) for k, e in enumerate(events)]


@pytest.mark.parametrize("long_log", [1 << 16, 1])
def test_fields_of_the_state_machine(spark, long_log):
    schema = "event_id long, user_id long, event string, at long, value double, text string"
    fields = ("status", "retries", "applied", "progress", "started", "finished", "error", "output")
    got = {r.user_id: r for r in batch.folded(spark.createDataFrame(_log(FIELDS), schema), long_log=long_log).collect()}
    for n, (events, want) in enumerate(FIELDS):
        assert tuple(got[n][f] for f in fields) == want and got[n].events == len(events), events
        state = queue.FRESH
        for _, _, event, at, value, text in _log([(events, None)]):
            state = queue.stepped(state, event, at, value, text)
        assert (*state[:3], *state[4:]) == want and state[3] == len(events)
    got = {r.user_id: r for r in batch.folded(spark.createDataFrame(_log(RETRIED), schema), auto=True, long_log=long_log).collect()}
    for n, (events, want) in enumerate(RETRIED):
        assert (got[n].status, got[n].retries, got[n].error) == want, events


def test_long_logs_are_cut(spark):
    rng = random.Random(5)
    names = [t[0] for t in batch.TRANSITIONS[:-1]] + ["progress"]
    log = [(n, rng.choice((1, 1, 1, 2)), rng.choice(names), n, rng.random(), f"t{n}") for n in range(600)]
    df = spark.createDataFrame(log, "event_id long, user_id long, event string, at long, value double, text string")
    for auto in (False, True):
        whole = sorted(map(tuple, batch.folded(df, auto).collect()))
        assert sorted(map(tuple, batch.folded(df, auto, long_log=37).collect())) == whole and len(whole) == 2


def test_throttle(spark):
    rows = [(1, n, n, 1000) for n in range(0, 1001)] + [(2, 0, 0, 10), (2, 1, 10, 10), (2, 2, 10, 10)] + [(3, n, n, 7) for n in (3, 7)]
    got = {r.key: (r.reports, r.passed) for r in batch.throttled(spark.createDataFrame(rows, "key long, number long, done long, total long")).collect()}
    assert got == {1: (1001, 101), 2: (3, 3), 3: (2, 2)}  # the first, then every hundredth; at the end every report


def test_admission_stops_at_the_first_that_does_not_fit(spark):
    waiting = spark.createDataFrame([(1, 300), (2, 500), (3, 10), (4, 10)], "id long, peak long")
    assert [r.id for r in batch.admitted(waiting, 4, 716).collect()] == [1]
    assert [r.id for r in batch.admitted(waiting, 4, 810).collect()] == [1, 2, 3]
    assert batch.admitted(waiting, 4, 716, held=500).count() == 0
    assert [r.id for r in batch.admitted(waiting, 1, 10_000).collect()] == [1]


def test_differences_across_stretches(spark):
    rng = random.Random(1)
    rows = [(n % 2, n * rng.choice((1, 3)), rng.randrange(-9, 9)) for n in range(100)]
    rows = list({r[:2]: r for r in rows}.values())
    want, last = {}, {}
    for comp, number, dc in sorted(rows):
        want[comp, number], last[comp] = dc - last.get(comp, 0), dc
    got = rasters.differences(spark.createDataFrame(rows, "comp int, number int, dc int"), 8)
    assert {(r.comp, r.number): r["diff"] for r in got.collect()} == want


def test_durable_snapshots_and_resuming(spark, tmp_path):
    folder = tmp_path / "in"
    log = [(5005 * n + 1, dt.datetime(2024, 1, 1), n, "click", 0.0, "") for n in range(4)]
    for k in range(2):
        spark.createDataFrame(log[k * 2 : k * 2 + 2], queue.EVENTS).coalesce(1).write.parquet(str(folder / f"events{k}"))
        events = spark.readStream.schema(queue.EVENTS).option("recursiveFileLookup", "true").parquet(str(folder))
        queue.durable_snapshots(queue.job_states(events), str(tmp_path / "jobs"), str(tmp_path / "check"), None).awaitTermination()
        kept = images.published(spark, str(tmp_path / "jobs"))
        assert sorted((r.user_id, r.status) for r in kept.collect()) == [(n, "running") for n in range(2 * k + 2)]
    ran = []
    assert queue.resumed(kept, True, lambda: ran.append(1)) and not queue.resumed(kept, False, lambda: ran.append(2))
    assert not queue.resumed(kept.where("false"), True, lambda: ran.append(3)) and ran == [1]


def test_runner(spark):
    waiting, ends, began = ["a", "bad", "slow", "last"], {}, []

    def work(job):
        began.append(job)
        if job == "bad":
            raise ValueError("no")
        if job == "slow":
            spark.range(1 << 45).selectExpr("sum(id % 7)").collect()

    runner = Runner(spark, lambda: waiting.pop(0) if waiting else None, work, lambda j, s, m: ends.__setitem__(j, s), workers=1)
    runner.start()
    runner.start()

    def wait(test):
        end = time.monotonic() + 60
        while not test() and time.monotonic() < end:
            time.sleep(0.05)
        assert test()

    wait(lambda: "slow" in began)
    assert ends == {"a": "completed", "bad": "failed"}
    runner.pause()
    time.sleep(1)
    runner.cancel_all()
    wait(lambda: ends.get("slow") == "cancelled")
    assert waiting == ["last"]
    runner.start()
    wait(lambda: ends.get("last") == "completed")
    runner.pause()


@pytest.mark.parametrize("late", [False, True])
def test_rows_are_assembled_in_order(spark, tmp_path, late):
    rng = random.Random(3)
    parts = [(1, y, x, 4, bytes([y % 251, x]) * 3) for y in range(700) for x in (0, 2)]
    rng.shuffle(parts)
    if late:  # a part of the first row comes last, when 699 rows wait for it
        parts.sort(key=lambda p: p[1:3] == (0, 2))
    schema = "image long, y int, x int, width int, data binary"
    for k in range(3):
        spark.createDataFrame(parts[k * 467 : k * 467 + 467], schema).coalesce(1).write.parquet(str(tmp_path / f"p{k}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path))
    got = queue.drained(queue.assembled_rows(stream), "append")
    assert sorted((r.y, bytes(r.rgb)) for r in got.collect()) == [(y, bytes([y % 251, 0]) * 3 + bytes([y % 251, 2]) * 3) for y in range(700)]


@pytest.mark.parametrize("tile", [5, 8, 64])
def test_tiles_give_the_whole_image(spark, tile):
    pixels = (np.arange(17)[:, None] * 13 + np.arange(21)[None] * 7) % 256
    rows = []
    for n, (x, y) in enumerate((x, y) for y in range(0, 17, tile) for x in range(0, 21, tile)):
        w, h = min(tile, 21 - x), min(tile, 17 - y)
        rows.append((1, n, x, y, w, h, w, h, 2, 2, engine.padded(pixels, x, y, w, h, engine.PAD).ravel().tolist()))
    df = spark.createDataFrame(rows, "id long, tile_no int, x int, y int, tw int, th int, own_w int, own_h int, base int, chain int, pixels array<int>")
    made, seen = engine.watched(engine.upscaled(df))
    out = np.zeros((68, 84), int)
    for t in made.collect():
        out[t.y : t.y + t.h, t.x : t.x + t.w] = np.array(t.pixels).reshape(t.h, t.w)
    assert (out == pixels.repeat(4, 0).repeat(4, 1)).all() and seen.get["done"] == len(rows)


def test_registered_engine(spark):
    engine.register_engine(spark, "double_nearest", engine.Nearest)
    assert spark.sql("SELECT double_nearest(array(1, 2), 2, 2) AS p").first().p == [1, 1, 2, 2, 1, 1, 2, 2]
