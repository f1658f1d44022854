"""Files, streams, quantiles and numbering."""

from __future__ import annotations

import datetime as dt
import json
import os
import uuid

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from swathline.functions.ranking import bucketed_row_number, exact_quantiles, value_slot
from swathline.functions.text import xmp_extract
from swathline.operators import aggregates, georef, matching, relations, validate
from swathline.plans.views import Tables
from swathline.sources import images, stores, tables
from swathline.streaming import callbacks, sinks, windows

from .conftest import FOLDER


@pytest.mark.parametrize("fine", [False, True])
def test_quantiles_on_a_hot_group(spark, fine):
    """A third of the rows share one value, one group has outliers of another scale."""
    rng = np.random.default_rng(0)
    a = np.concatenate([np.full(3000, 0.5), rng.normal(0, 1, 6000), [1e9, -1e9]])
    b = rng.random(7)
    rows = [("a", float(v)) for v in a] + [("b", float(v)) for v in b] + [("c", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: r for r in exact_quantiles(df, ["g"], "v", {"p1": .01, "q": .25, "m": .5, "p99": .99}, fine=fine).collect()}
    for g, arr in (("a", a), ("b", b)):
        want = np.percentile(arr, [1, 25, 50, 99])
        assert np.allclose([got[g][k] for k in ("p1", "q", "m", "p99")], want)
    assert "c" not in got


def test_quantiles_without_keys_and_with_weights(spark):
    df = spark.createDataFrame([(1.0, 3), (2.0, 1), (10.0, 4)], "v double, n long")
    got = exact_quantiles(df, [], "v", {"m": .5, "x": 1.0}, weight="n").first()
    assert got["m"] == np.median([1, 1, 1, 2, 10, 10, 10, 10]) and got["x"] == 10


def test_slots_follow_the_values(spark):
    rng = np.random.default_rng(1)
    v = np.sort(np.concatenate([rng.normal(0, 10.0 ** rng.integers(-12, 12, 4000)), 2.0 ** np.arange(-20, 20), [0, np.inf, -np.inf, 1e-310]]))
    rows = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "i int, v double")
    got = [r["s"] for r in rows.select("i", value_slot(F.col("v")).alias("s")).orderBy("i").collect()]
    assert got == sorted(got)


def test_row_numbers_across_buckets(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("k"), F.col("id"))
    got = bucketed_row_number(df, ["k"], ["id"], F.floor(F.col("id") / 37))
    assert got.where(F.floor(F.col("id") / 2) + 1 != F.col("ordinal")).count() == 0 and got.count() == 1000


def test_scan_images(spark, tmp_path):
    for name in ("b.JPG", "a.tif", "notes.txt", "sub/c.dng", "sub/.hidden"):
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_bytes(b"x")
    got = [r["path"].rsplit("/", 1)[1] for r in images.scan_images(spark, str(tmp_path)).collect()]
    assert sorted(got) == ["a.tif", "b.JPG", "c.dng"]
    flat = [r["path"].rsplit("/", 1)[1] for r in images.scan_images(spark, str(tmp_path), recursive=False).collect()]
    assert sorted(flat) == ["a.tif", "b.JPG"]


def test_mark_file(spark, tmp_path):
    (tmp_path / "f.MRK").write_text(
        "# head\n1 381207.125000 [2290] 12,N 7,E -31,V 33.50210044,Lat 18.91400210,Lon 212.25,Ellh\n"
        "2 2024/07/19 08:43:15 41.5 23.5 90.25\n\n2 2024/07/19T08:43:16 41.6 23.6 91.5\nx 1 2 3\n")
    got = {r["seq"]: (r["lat"], r["lon"], r["alt"]) for r in tables.mrk_read(spark, str(tmp_path)).collect()}
    assert got == {"0001": (33.50210044, 18.91400210, 212.25), "0002": (41.6, 23.6, 91.5)}


def test_control_and_spectra_files(spark, tmp_path):
    (tmp_path / "gcp.csv").write_text("point_id,x,y\na,1,2\nb,3,4\na,5,6\n")
    got = {r["id"]: (r["x"], r["y"], r["z"]) for r in tables.gcp_read(spark, str(tmp_path / "gcp.csv")).collect()}
    assert got == {"a": (5.0, 6.0, None), "b": (3.0, 4.0, None)}
    (tmp_path / "s.csv").write_text("id,red,green\n1,.1,.2\n2,bad,.5\n3,.4,\n")
    rows = {(r["band"], r["ordinal"]): r["value"] for r in tables.spectra_read(spark, str(tmp_path / "s.csv")).collect()}
    assert rows == {("red", 1): .1, ("red", 2): .4, ("green", 1): .2, ("green", 2): .5}


def test_pose_and_statistics_files(spark, tmp_path):
    (tmp_path / "camera_poses.txt").write_text("# id name q t\n7 a.jpg 1 0 0 0 1.5 2 3\n8 short\n")
    r = tables.poses_read(spark, str(tmp_path / "camera_poses.txt")).first()
    assert (r["image_id"], r["qw"], r["tx"], r["tz"]) == ("7", 1.0, 1.5, 3.0)
    doc = {"outputs": {"dsm.tif": {"width": 5, "bands": 2, "geotransform": [0, 0.05, 0, 0, 0, -0.05]}, "x": {"width": 1}}}
    (tmp_path / "stats.json").write_text(json.dumps(doc, indent=1))
    got = {r["type"]: r for r in tables.stats_read(spark, str(tmp_path / "stats.json")).collect()}
    assert got["dsm"]["resolution_cm"] == 5.0 and got["dsm"]["bands"] == ["band_1", "band_2"] and got["x"]["bands"] is None


def test_tiles_and_manifests_on_disk(spark, make_raster, tmp_path):
    arr = np.arange(100.0).reshape(10, 10)
    stores.tiles_write(make_raster({"red": arr, "nir": arr + 1}), str(tmp_path / "t"), block=4)
    got = stores.tiles_read(spark, str(tmp_path / "t"), bands=["red"], bbox=(2, 3, 5, 9), block=4)
    assert {(r["row"], r["col"]): r["value"] for r in got.collect()} == {
        (r, c): arr[r, c] for r in range(2, 6) for c in range(3, 10)}
    rows = [("d", 1, "red", "p/1", "dji", "M3M"), ("d", 2, "unknown", "p/2", "unknown", None)]
    m = spark.createDataFrame(rows, "dataset_id string, folder_no int, band string, file_path string, manufacturer string, drone_model string")
    stores.manifest_write(m, str(tmp_path / "m"))
    back = stores.manifest_rebuild(stores.manifest_read(spark, str(tmp_path / "m"))).first()
    assert back["manufacturer"] == "dji" and back["drone_model"] == "M3M" and back["is_multispectral"]
    whole = stores.manifest_datasets(spark, str(tmp_path / "m")).collect()
    assert [tuple(r) for r in whole] == [("d", 2, ["red", "unknown"], "dji", "M3M", True)]
    stores.manifest_write(m.where("folder_no > 5"), str(tmp_path / "none"))
    assert stores.manifest_datasets(spark, str(tmp_path / "none")).collect() == []
    stores.manifest_write(m.drop("manufacturer"), str(tmp_path / "few"))
    assert stores.manifest_read(spark, str(tmp_path / "few")).count() == 2 and not os.path.exists(tmp_path / "few" / "_datasets")
    stores.report_write(m, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).count() == 2


def _counting(spark):
    """(accumulator, function of a text column that counts the rows it is worked out for)."""
    seen = spark.sparkContext.accumulator(0)

    def work(text):
        seen.add(1)
        return text

    return seen, F.udf(work, "string").asNondeterministic()


CLASSIFIED = "dataset_id string, folder_no int, band string, file_path string, manufacturer string, drone_model string, error string"


def test_a_manifest_works_its_images_out_once(spark, tmp_path):
    seen, counted = _counting(spark)
    rows = [("d", i, "red", f"p/{i}", "dji", None, None) for i in range(40)]
    m = spark.createDataFrame(rows, CLASSIFIED).withColumn("file_path", counted("file_path"))
    stores.manifest_write(m, str(tmp_path / "m"))
    assert seen.value == 40
    assert [tuple(r) for r in stores.manifest_datasets(spark, str(tmp_path / "m")).collect()] == [("d", 40, ["red"], "dji", None, True)]


def test_a_manifest_group_works_its_images_out_once(spark):
    seen, counted = _counting(spark)
    rows = [("d", 0, "red", "p/1", "a", "M", None), ("d", 0, "red", "p/2", "b", None, None), ("d", 0, "nir", "p/3", "b", None, "bad"),
            ("e", 0, "rgb", "p/4", "c", "N", "bad")]
    m = spark.createDataFrame(rows, CLASSIFIED).withColumn("file_path", counted("file_path"))
    got = {r["dataset_id"]: tuple(r)[1:] for r in aggregates.manifest_group(m).collect()}
    assert got == {"d": (3, 1, {"red": 2}, True, "a", "M"), "e": (1, 1, None, False, "unknown", None)}
    assert seen.value == 4


def test_a_single_batch_is_read_without_merging(spark, tmp_path):
    merged = []

    def merge(rows):
        merged.append(rows)
        return rows.groupBy("k").agg(F.max("v").alias("v"))

    rows = spark.createDataFrame([(1, 2), (1, 3), (2, 1)], "k int, v int")
    table = sinks.MergedTable(spark, str(tmp_path / "t"), rows.schema, merge)
    table.write(rows, 0)
    assert sorted(map(tuple, table.read().collect())) == [(1, 3), (2, 1)] and len(merged) == 1
    table.write(rows.where("v = 1").withColumn("v", F.lit(9)), 1)
    assert sorted(map(tuple, table.read().collect())) == [(1, 3), (2, 9)] and len(merged) == 3


def _split_stream(spark, t, tmp_path, parts=4):
    """The events as several files, so a stream sees several micro-batches."""
    src = str(tmp_path / "in")
    ordered = t.events.repartitionByRange(parts, "event_id").sortWithinPartitions("event_id")
    ordered.write.parquet(src)
    # the source takes files by modification time
    for i, name in enumerate(sorted(n for n in os.listdir(src) if n.startswith("part-"))):
        os.utime(os.path.join(src, name), (1_700_000_000 + i * 10,) * 2)
    live = Tables(spark, FOLDER)
    live._known["events"] = spark.readStream.schema(t.events.schema).option("maxFilesPerTrigger", 1).parquet(src)
    return live


def _run(df, mode, tmp_path):
    base = tmp_path / uuid.uuid4().hex
    w = df.writeStream.outputMode(mode).option("checkpointLocation", str(base / "state")).trigger(availableNow=True)
    out = str(base / "out")
    q = (w.format("parquet").option("path", out).start() if mode == "append" else
         w.foreachBatch(lambda d, _: d.write.mode("overwrite").parquet(out)).start())
    assert q.awaitTermination(120)
    return df.sparkSession.read.schema(df.schema).parquet(out)


def test_streams_equal_batches(spark, tmp_path):
    t = Tables(spark, FOLDER)
    live = _split_stream(spark, t, tmp_path)
    fold = _run(callbacks.callback_fold(live.callbacks), "complete", tmp_path)
    assert sorted(map(str, fold.collect())) == sorted(map(str, callbacks.callback_fold(t.callbacks).collect()))
    durations = _run(callbacks.stage_machine_stream(live.stage_events), "append", tmp_path)
    twin = callbacks.stage_durations(t.stage_events).select("event_id", "job_id", "stage", "duration_seconds")
    want = {r["event_id"]: r["duration_seconds"] for r in twin.collect()}
    got = {r["event_id"]: r["duration_seconds"] for r in durations.collect()}
    assert got.keys() == want.keys()
    # state lapses after 72 hours of event time, so a start older than that may be forgotten
    assert all(got[k] == pytest.approx(want[k]) for k in want if want[k] is not None and want[k] < 72 * 3600)
    hourly = _run(windows.hourly_counter(live.callbacks), "complete", tmp_path)
    assert {(r["hour"], r["n"]) for r in hourly.collect()} == {
        (r["hour"], r["n"]) for r in windows.hourly_counter(t.callbacks).select(F.col("hour").cast("timestamp").alias("hour"), "n").collect()}


def test_alarm_needs_consecutive_periods(spark):
    rows = [("m", "2024-01-01 00:01:00", 9.0), ("m", "2024-01-01 00:06:00", 9.0), ("m", "2024-01-01 00:16:00", 9.0)]
    df = spark.createDataFrame(rows, "metric string, ts string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    two = windows.alarm(windows.period_means(df), 5.0).collect()
    assert [str(r["start"]) for r in two] == ["2024-01-01 00:05:00"]
    same = windows.alarm_stream(df, 5.0).collect()
    assert [str(r["start"]) for r in same] == ["2024-01-01 00:05:00"]


def test_matches_do_not_depend_on_blocks(spark):
    rng = np.random.default_rng(2)
    a = rng.normal(size=(40, 16))
    b = a + rng.normal(size=a.shape) * 0.1
    rows = [(i, k * 40 + n, (v / np.linalg.norm(v)).tolist()) for k, (i, m) in enumerate((("a", a), ("b", b))) for n, v in enumerate(m)]
    d = spark.createDataFrame(rows, "image_id string, desc_id long, vec array<double>")
    p = spark.createDataFrame([("a", "b")], "image_a string, image_b string")
    big = {(r["desc_a"], r["desc_b"]) for r in matching.ratio_match(d, p).collect()}
    small = {(r["desc_a"], r["desc_b"]) for r in matching.ratio_match(d, p, block=7).collect()}
    assert big == small == {(n, n + 40) for n in range(40)}


def test_skill_edges(spark):
    pairs = spark.createDataFrame([("x", 1.0, 1.0), ("y", 2.0, 2.0), ("y", 2.0, 2.0), ("z", 2.0, 1.0), ("z", 2.0, 2.0), ("p", 1.0, 3.0), ("p", 2.0, -3.0)],
                                  "band string, reference double, measured double")
    got = {r["band"]: r["r2"] for r in validate.r2_skill(pairs, 0.85).collect()}
    assert got["x"] == 0.0 and got["y"] == 1.0 and got["z"] == 0.0 and got["p"] < 0


def test_checkpoints_without_match(spark):
    schema = "id string, x double, y double, z double"
    got = validate.checkpoint_rmse(spark.createDataFrame([("a", 1.0, 1.0, 1.0)], schema), spark.createDataFrame([("b", 1.0, 1.0, 1.0)], schema)).first()
    assert got["rmse_horizontal"] == float("inf") and not got["passed_horizontal"] and got["passed_vertical"]


class State:
    """A group's state outside of a stream."""

    def __init__(self):
        self.value, self.exists, self.hasTimedOut = None, False, False

    @property
    def get(self):
        return self.value

    def update(self, value):
        self.value, self.exists = value, True

    def remove(self):
        self.value, self.exists = None, False

    def setTimeoutTimestamp(self, at):
        self.until = at

    def getCurrentWatermarkMs(self):
        return 0


def _batch(*events):
    return pd.DataFrame([(i, pd.Timestamp(f"2024-01-01 {at}"), action) for i, at, action in events], columns=["event_id", "ts", "action"])


def test_late_starts_do_not_replace_newer_ones():
    work, state = callbacks._advance(1000), State()

    def seconds(*events):
        return {r.event_id: r.duration_seconds for out in work((1, "queued"), iter([_batch(*events)]), state) for r in out.itertuples()}

    assert seconds((1, "10:30", "start")) == {}
    assert seconds((2, "10:10", "start"), (3, "10:40", "complete")) == {3: 600.0}
    assert seconds((4, "10:35", "start"), (5, "10:36", "complete")) == {5: 60.0}
    late = seconds((6, "10:20", "complete"))
    assert list(late) == [6] and np.isnan(late[6])


def test_a_batch_without_completions_makes_no_frame():
    work, state = callbacks._advance(1000, every=True), State()
    assert list(work((1, "sfm"), iter([_batch((1, "10:30", "start")), _batch((2, "10:20", "start"), (3, "10:31", "fail"))]), state)) == []
    out = list(work((1, "sfm"), iter([_batch((5, "10:30", "complete")), _batch((4, "10:25", "complete"))]), state))
    assert [(r.event_id, r.duration_seconds) for r in out[0].itertuples()] == [(4, 300.0), (5, 0.0)]


def test_progress_without_a_number_keeps_the_progress(spark):
    cols = "event_id long, job_id long, ts timestamp, type string, progress int, current_stage string, stage_progress int, error_message string, failed_types string"
    at = [dt.datetime(2024, 1, 1, 10, m) for m in range(4)]
    events = spark.createDataFrame([(1, 1, at[0], "progress", 40, "queued", 10, None, None), (2, 1, at[1], "progress", None, None, None, None, None),
                                    (3, 9, at[2], "progress", 70, None, None, None, None), (4, 9, at[3], "odd", None, None, None, None, None)], cols)
    jobs = spark.createDataFrame([(1,)], "job_id long")
    assert {r["job_id"]: r["progress"] for r in callbacks.callback_fold(events).collect()} == {1: 40, 9: 70}
    assert [r["job_id"] for r in callbacks.callback_fold(events, jobs).collect()] == [1]
    assert sorted(r["event_id"] for r in callbacks.callback_rejects(events, jobs).collect()) == [3, 4]


def test_skill_with_infinities(spark):
    pairs = spark.createDataFrame([("red", 1.0, 1.1), ("red", 2.0, 2.0), ("red", 3.0, float("inf")), ("red", float("nan"), 1.0)],
                                  "band string, reference double, measured double")
    got = {r["band"]: r for r in validate.r2_skill(pairs, 0.5, finite_only=True).collect()}
    assert got["red"]["n"] == 2 and got["red"]["passed"]
    loose = validate.r2_skill(pairs.where("reference = 3 OR reference < 3"), 0.5).collect()
    assert not any(r["passed"] for r in loose)


def test_element_properties_of_any_namespace(spark):
    texts = ["<MicaSense:CaptureId>abc</MicaSense:CaptureId>", '<rdf:x other:CaptureId="q"/>', "<other:CaptureId rdf:a='b'>e</other:CaptureId>",
             'CaptureId="bare"', '<a other:CaptureId="no"/><MicaSense:CaptureId>yes</MicaSense:CaptureId>', "<NotCaptureId>n</NotCaptureId>"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, xmp string")
    got = [r["CaptureId"] for r in xmp_extract(df, props=["CaptureId"]).orderBy("k").collect()]
    assert got == ["abc", "q", "e", "bare", "yes", None]


def test_exposures_pair_within_their_dataset(spark):
    files = [(1, "green", "DJI_0001_MS_G.tif"), (2, "green", "DJI_0001_MS_G.tif")]
    images = spark.createDataFrame([(d, b, f.replace(".tif", "_reflectance.tif")) for d, b, f in files], "dataset_id int, band string, file_name string")
    raws = spark.createDataFrame([(1, "green", "X_0001_MS_G.tif"), (2, "green", "Y_0001_MS_G.tif")], "dataset_id int, band string, file_name string")
    got = {r["dataset_id"]: r["raw_name"] for r in relations.capture_pair(images, raws).collect()}
    assert got == {1: "X_0001_MS_G.tif", 2: "Y_0001_MS_G.tif"}
    marks = spark.createDataFrame([(1, "0001", 1.0, 1.0, 1.0), (2, "0001", 2.0, 2.0, 2.0)], "dataset_id int, seq string, lat double, lon double, alt double")
    shots = spark.createDataFrame([(d, "DJI_0001_D.JPG", 0.0, 0.0, 0.0) for d in (1, 2, 3)], "dataset_id int, file_name string, lat double, lon double, alt double")
    assert {r["dataset_id"]: r["lat"] for r in relations.ppk_upgrade(shots, marks).collect()} == {1: 1.0, 2: 2.0, 3: 0.0}


def test_events_go_to_their_organisation(spark):
    events = spark.createDataFrame([(1, 7, "done"), (2, 8, "done")], "event_id int, org_id int, event_type string")
    hooks = spark.createDataFrame([(10, 7, "u", ["done"], True), (11, 8, "v", ["done", "done"], True), (12, 8, "w", ["done"], False)],
                                  "hook_id int, org_id int, url string, events array<string>, active boolean")
    assert sorted((r["event_id"], r["hook_id"]) for r in relations.webhook_fanout(events, hooks).collect()) == [(1, 10), (2, 11)]


def test_fanout_of_one_file_is_dealt_over_all_tasks(spark, tmp_path):
    spark.range(2000).select(F.col("id").alias("event_id"), F.lit("done").alias("event_type")).coalesce(1).write.parquet(str(tmp_path / "e"))
    hooks = spark.range(50).select(F.col("id").alias("hook_id"), F.lit(1).alias("org_id"), F.lit("u").alias("url"),
                                   F.array(F.lit("done")).alias("events"), F.lit(True).alias("active"))
    out = relations.webhook_fanout(spark.read.parquet(str(tmp_path / "e")), hooks)
    share = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(share) == 100_000 and max(share) < 25_000


def test_fanout_takes_few_bytes_in_files(spark, tmp_path):
    events = spark.range(2400).select((F.col("id") * 1_000_003).alias("event_id"), F.lit("done").alias("event_type"))
    hooks = spark.range(1500).select(F.col("id").alias("hook_id"), F.lit(1).alias("org_id"), F.concat(F.lit("u"), F.col("id")).alias("url"),
                                     F.array(F.lit("done")).alias("events"), F.lit(True).alias("active"))
    relations.webhook_fanout(events, hooks).write.parquet(str(tmp_path / "f"))
    assert spark.read.parquet(str(tmp_path / "f")).distinct().count() == 3_600_000
    assert sum(p.stat().st_size for p in (tmp_path / "f").glob("*.parquet")) < 3_600_000 * 0.7


def test_fanout_without_broadcast_keeps_its_tasks(spark):
    events = spark.range(2000).select(F.col("id").alias("event_id"), F.concat(F.lit("t"), F.col("id") % 5).alias("event_type"))
    hooks = spark.range(50).select(F.col("id").alias("hook_id"), F.lit(1).alias("org_id"), F.lit("u").alias("url"),
                                   F.array(*[F.lit(f"t{i}") for i in range(5)]).alias("events"), F.lit(True).alias("active"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        share = [r["count"] for r in relations.webhook_fanout(events, hooks).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sum(share) == 100_000 and max(share) < 40_000


@pytest.mark.parametrize("broadcast", ["10m", "-1"])
@pytest.mark.parametrize("columns", [["event_id", "event_type"], ["org_id", "event_id", "event_type", "x"], ["event_type"], ["org_id", "event_type"]])
def test_fanout_in_blocks_is_the_plain_join(spark, columns, broadcast):
    kind = F.when(F.col("id") % 3 != 0, "a").when(F.col("id") % 9 != 0, "b").when(F.col("id") % 2 == 0, "none")
    events = spark.range(3000).select((F.col("id") % 2500).alias("event_id"), kind.alias("event_type"),
                                      F.when(F.col("id") % 5 != 0, F.col("id") % 4).cast("int").alias("org_id"),
                                      F.when(F.col("id") % 7 != 0, F.col("id") / 2).alias("x")).select(*columns)
    hooks = spark.range(60).select((F.col("id") % 50).alias("hook_id"), F.when(F.col("id") % 6 != 0, F.col("id") % 3).cast("int").alias("org_id"),
                                   F.when(F.col("id") % 8 != 0, F.lit("u")).alias("url"), F.expr("IF(id % 2 = 0, array('a', 'b', 'a', NULL), array('b'))").alias("events"),
                                   (F.col("id") % 10 != 0).alias("active"))
    on = [k for k in ("org_id", "event_type") if k in columns]
    wanted = hooks.where("active").select("hook_id", "org_id", "url", F.explode(F.array_distinct("events")).alias("event_type"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        got = relations.webhook_fanout(events, hooks, salts=3, block=100)
        want = events.join(wanted, on).select(*got.columns)
        assert sorted(got.columns) == sorted({*columns, "hook_id", "org_id", "url"})
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_boxes_of_one_file_meet_in_all_tasks(spark, tmp_path):
    box = spark.range(600).select("id", *[F.lit(float(v)).alias(n) for n, v in (("xmin", 0), ("ymin", 0), ("xmax", 1), ("ymax", 1))])
    box.coalesce(1).write.parquet(str(tmp_path / "b"))
    boxes = spark.read.parquet(str(tmp_path / "b"))
    share = [r["count"] for r in georef.footprint_overlap(boxes, boxes, 50.0).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(share) == 360_000 and max(share) < 90_000


def test_images_of_one_file_pair_in_all_tasks(spark, tmp_path):
    spark.range(600).select(F.col("id").alias("image_id"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y")).coalesce(1).write.parquet(str(tmp_path / "i"))
    out = matching.image_pairs(spark.read.parquet(str(tmp_path / "i")), "spatial", radius=5.0)
    share = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(share) == 600 * 599 // 2 and max(share) < 60_000


def test_descriptors_go_to_sixteen_blocks_at_most(spark, monkeypatch):
    """An image with very many descriptors is not copied once per ``block`` of the other image."""
    tasks = []
    monkeypatch.setattr(matching, "_two_best", lambda block: lambda left, right: pd.DataFrame({"pair": ["p"], "side": ["s"], "q": [0], "m": [0], "dot": [0.0]}))
    monkeypatch.setattr(matching, "top_per_group", lambda found, *rest: tasks.append(found.count()) or found)
    vec = F.array(F.lit(1.0), F.lit(0.0))
    d = spark.range(200).select((F.col("id") % 2).alias("image_id"), F.col("id").alias("desc_id"), vec.alias("vec"))
    matching.ratio_match(d, spark.createDataFrame([(0, 1)], "image_a long, image_b long"), block=2)
    assert tasks[0] <= 2 * 16 * 16


@pytest.mark.parametrize("columns", [1, 2, 7])
def test_first_two_equal_a_stable_sort(columns):
    rng = np.random.default_rng(columns)
    dots = rng.integers(0, 3, (200, columns)).astype(float)
    dots[rng.random(dots.shape) < 0.2] = np.nan
    best, values = matching._first_two(dots)
    assert np.array_equal(best, np.argsort(-dots, axis=1, kind="stable")[:, :2])
    assert np.array_equal(values, np.take_along_axis(dots, best, 1), equal_nan=True)


def test_skipped_stages_are_passed_over(spark):
    cols = "event_id long, job_id long, ts timestamp, stage string, action string, skipped array<string>"
    at = [dt.datetime(2024, 1, 1, 10, m) for m in range(3)]
    events = spark.createDataFrame([(1, 1, at[0], "sfm", "start", None), (2, 1, at[1], "sfm", "complete", ["orthomosaic"]),
                                    (3, 2, at[0], "uploading", "complete", ["publishing"]), (4, 3, at[0], "sfm", "complete", None)], cols)
    assert {r["event_id"]: r["next_stage"] for r in callbacks.stage_durations(events).collect()} == {2: "uploading", 3: "completed", 4: "orthomosaic"}
    state = {r["job_id"]: (r["status"], r["current_stage"]) for r in callbacks.stage_machine(events).collect()}
    assert state == {1: ("running", "uploading"), 2: ("completed", "completed"), 3: ("pending", "orthomosaic")}
