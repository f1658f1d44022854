"""Streams of several micro-batches: state that lapses, merged tables, late events, windows that close."""

from __future__ import annotations

import datetime as dt
import os
import random
import uuid

import pandas as pd
import pytest
from pyspark.sql import functions as F

from swathline.plans.registry import QUERIES
from swathline.plans.streams import run_to_end
from swathline.plans.views import Tables
from swathline.streaming import callbacks, sinks, windows

CALLBACKS = ("event_id long, job_id long, ts timestamp, type string, progress int, current_stage string, stage_progress int, "
             "error_message string, failed_types string")
STAGES = "event_id long, job_id long, ts timestamp, stage string, action string, skipped array<string>"


def at(day: int, hour: int = 0, minute: int = 0) -> dt.datetime:
    return dt.datetime(2024, 1, 1, hour, minute) + dt.timedelta(days=day)


def live(spark, folder, batches, schema):
    """One file, and so one micro-batch, for each list of rows."""
    src = str(folder / uuid.uuid4().hex)
    for i, rows in enumerate(batches):
        before = set(os.listdir(src)) if os.path.isdir(src) else set()
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        for name in set(os.listdir(src)) - before:
            os.utime(os.path.join(src, name), (1_700_000_000 + 10 * i,) * 2)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)


def rows_of(df, mode, folder):
    """What comes out, batch by batch."""
    seen = []
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", str(folder / uuid.uuid4().hex)).trigger(availableNow=True)
    assert writer.foreachBatch(lambda part, batch: seen.append(part.collect())).start().awaitTermination(120)
    return seen


def test_state_is_gone_72_hours_after_the_last_write(spark, tmp_path):
    def step(i, job, day, percent):
        return (i, job, at(day), "progress", percent, "sfm", 100, None, None)

    batches = [[step(1, 1, 0, 10), step(2, 2, 0, 20)], [step(3, 2, 2, 30)], [step(4, 3, 4, 40)], [step(5, 3, 4, 50)], [step(6, 1, 5, 60)], [step(7, 2, 5, 70)]]
    seen = rows_of(callbacks.callback_fold_stream(live(spark, tmp_path, batches, CALLBACKS)), "update", tmp_path)
    last = [r for part in seen for r in part]
    # job 1 was silent for more than 72 hours, job 2 never was
    assert [(r.events, r.progress, r.expired) for r in last if r.job_id == 1] == [(1, 10, False), (1, 10, True), (1, 60, False)]
    assert [(r.events, r.progress, r.expired) for r in last if r.job_id == 2] == [(1, 20, False), (2, 30, False), (3, 70, False)]
    assert [r.updated_at for r in last if r.job_id == 2][-1] == at(5) and {r.last_successful_stage for r in last} == {"sfm"}


def test_the_fold_does_not_depend_on_batches(spark, tmp_path):
    rnd = random.Random(3)
    kinds = ["progress", "complete", "error", "upload_status", "odd"]
    rows = [(i, rnd.randrange(5), at(1, rnd.randrange(10), rnd.randrange(60)), rnd.choice(kinds), rnd.choice([None, 5, 50]), rnd.choice([None, "", "sfm", "strange"]),
             rnd.choice([50, 100]), rnd.choice([None, "broken"]), rnd.choice(["", "dsm,ndvi"])) for i in range(300)]
    source = live(spark, tmp_path, [rows[k::6] for k in range(6)], CALLBACKS)
    newest = {r.job_id: r for part in rows_of(callbacks.callback_fold_stream(source, delay="1 day"), "update", tmp_path) for r in part}
    twin = callbacks.callback_fold(spark.createDataFrame(rows, CALLBACKS))
    assert {j: tuple(r[c] for c in twin.columns) for j, r in newest.items()} == {r.job_id: tuple(r) for r in twin.collect()}


def test_stage_state_in_any_order_with_skipped_stages(spark, tmp_path):
    rows = [(1, 1, at(0, 10, 0), "sfm", "start", None), (2, 1, at(0, 10, 9), "sfm", "complete", ["orthomosaic"]), (3, 1, at(0, 10, 5), "sfm", "fail", None),
            (4, 2, at(0, 10, 1), "uploading", "complete", ["publishing"]), (5, 3, at(0, 10, 1), "sfm", "complete", None), (6, 1, at(0, 10, 1), "sfm", "start", None)]
    twin = {r.job_id: tuple(r) for r in callbacks.stage_machine(spark.createDataFrame(rows, STAGES)).collect()}
    for order in (rows, rows[::-1]):
        source = live(spark, tmp_path, [order[:2], order[2:3], order[3:]], STAGES)
        got = {r.job_id: tuple(r)[:5] for part in rows_of(callbacks.stage_state_stream(source), "update", tmp_path) for r in part}
        assert got == twin and got[1][1:3] == ("failed", "uploading")


def test_late_start_and_completion_pair_up(spark, tmp_path):
    one = [(1, 1, at(0, 10, 30), "sfm", "start", None)]
    late = [(2, 1, at(0, 10, 10), "sfm", "start", None)]
    done = [(3, 1, at(0, 10, 20), "sfm", "complete", ["orthomosaic"]), (4, 1, at(0, 10, 40), "sfm", "complete", None), (5, 1, at(0, 10, 5), "sfm", "complete", None)]
    source = live(spark, tmp_path, [one, late, done], STAGES)
    out = callbacks.stage_machine_stream(source, following=True)
    got = {r.event_id: (r.duration_seconds, r.next_stage) for part in rows_of(out, "append", tmp_path) for r in part}
    assert got[3] == (600.0, "uploading") and got[4] == (600.0, "orthomosaic") and got.keys() == {3, 4, 5}
    assert got[5][0] is None or got[5][0] != got[5][0]


def test_starts_before_the_watermark_are_forgotten_but_the_newest():
    from tests.test_tables import State, _batch

    class Marked(State):
        def getCurrentWatermarkMs(self):
            return int(dt.datetime(2024, 1, 1, 10, 45, tzinfo=dt.UTC).timestamp()) * 1000

    work, state = callbacks._advance(1000, every=True), Marked()
    for event in ((1, "10:10", "start"), (2, "10:30", "start"), (3, "10:50", "start"), (4, "10:55", "start")):
        list(work((1, "sfm"), iter([_batch(event)]), state))
    assert len(state.value[0]) == 3
    out = next(work((1, "sfm"), iter([_batch((5, "10:49", "complete"))]), state))
    assert out["duration_seconds"].tolist() == [19 * 60.0]


UPLOADS = "dataset_id int, job_id int, type string, created_at timestamp, seq int, revision int, uri string, resolution_cm double"


def uploads(n: int, seed: int = 1):
    rnd = random.Random(seed)
    return [(rnd.randrange(3), rnd.randrange(2), rnd.choice(["dsm", "ndvi", None]), at(rnd.randrange(4)), rnd.randrange(3), i, rnd.choice([None, f"u{i}"]),
             rnd.choice([None, 2.0, 5.0])) for i in range(n)]


def test_products_as_they_arrive_equal_the_batch(spark, tmp_path):
    rows = uploads(120)
    parts = callbacks.product_parts(live(spark, tmp_path, [rows[i:i + 20] for i in range(0, 120, 20)], UPLOADS))
    table = sinks.MergedTable(spark, str(tmp_path / "table"), parts.schema, callbacks.merge_products, every=2)
    assert table.read().collect() == []

    def put(part, batch):
        table.write(part, batch)
        table.write(part, batch)  # a batch that is run again

    writer = parts.writeStream.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True)
    assert writer.foreachBatch(put).start().awaitTermination(240)
    want = callbacks.dedupe_product(spark.createDataFrame(rows, UPLOADS))
    again = sinks.MergedTable(spark, str(tmp_path / "table"), parts.schema, callbacks.merge_products, every=2)
    assert sorted(map(str, callbacks.finish_products(again.read()).collect())) == sorted(map(str, want.collect()))
    assert {r.batch for r in again._of("base").select("batch").distinct().collect()} >= {1, 3, 5}


@pytest.mark.parametrize("n", [1, 2])
def test_alarms_come_out_once_when_their_window_closes(spark, tmp_path, n):
    schema = "metric string, ts timestamp, value double"
    high = [("m", at(0, 10, k), 9.0) for k in (1, 6)]
    source = live(spark, tmp_path, [high, [("m", at(0, 10, 7), 9.0)], [("m", at(0, 20, 0), 1.0)]], schema)
    got = [(r.start, r.mean) for part in rows_of(windows.alarm_stream(source, 5.0, n=n), "append", tmp_path) for r in part]
    want = windows.alarm(windows.period_means(spark.createDataFrame([*high, ("m", at(0, 10, 7), 9.0)], schema)), 5.0, n)
    assert sorted(got) == sorted((r.start, r.mean) for r in want.collect()) and len(got) == 3 - n


def test_update_mode_takes_an_alarm_back(spark, tmp_path):
    source = live(spark, tmp_path, [[("m", at(0, 10, 1), 9.0)], [("m", at(0, 10, 2), 0.0)]], "metric string, ts timestamp, value double")
    newest = {r.start: r.fires for part in rows_of(windows.alarm_states(source.select(F.col("*")), 5.0, n=1), "update", tmp_path) for r in part}
    assert newest == {at(0, 10, 0): False}


HOOKS = "hook_id long, org_id int, url string, events array<string>, active boolean"


def test_fanned_out_stream_takes_few_bytes_and_is_the_plain_join(spark, tmp_path):
    """The query on one large batch: what the stream leaves in its folder is a fraction of a byte a row."""
    pd.DataFrame({"event_id": [i * 1_000_003 for i in range(2000)], "event_type": "error"}).to_parquet(tmp_path / "events.parquet")
    spark.range(3000).select((F.col("id") * 3 + 1).alias("s_suppkey"), F.lit(1).alias("s_nationkey")).write.parquet(str(tmp_path / "supplier.parquet"))
    out = QUERIES["webhook_stream"](Tables(spark, str(tmp_path)))
    rows, pairs = out.count(), out.select("event_id", "hook_id").distinct().count()
    assert rows == pairs == 2000 * 2250
    assert sum(os.path.getsize(f.removeprefix("file://")) for f in out.inputFiles()) < rows * 0.4


@pytest.mark.parametrize("batches", [[[(1, "a"), (2, "b")], [(3, "a"), (3, "a")], [(4, "c")]], []])
def test_fanned_out_batches(spark, tmp_path, batches):
    hooks = spark.createDataFrame([(10, 1, "u", ["a", "b", "a"], True), (11, 1, None, ["a"], True), (12, 1, "w", ["b"], False)], HOOKS)
    os.makedirs(tmp_path / "none")
    src = live(spark, tmp_path, batches, "event_id long, event_type string") if batches else \
        spark.readStream.schema("event_id long, event_type string").parquet(str(tmp_path / "none"))
    out = run_to_end(src, "append", each=lambda part: windows.webhook_stream(part, hooks))
    want = [(1, 10), (1, 11), (2, 10), (3, 10), (3, 10), (3, 11), (3, 11)] if batches else []
    assert sorted((r.event_id, r.hook_id) for r in out.collect()) == want
    # without a batch to work on, each event of a stream meets the subscribers by itself
    plain = rows_of(windows.webhook_stream(src, hooks), "append", tmp_path)
    assert sorted((r.event_id, r.hook_id) for part in plain for r in part) == want
