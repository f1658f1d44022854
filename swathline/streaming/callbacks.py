"""Job callbacks and stage events folded into job state.

Each fold is written for batch and streaming input alike where a mergeable aggregate can say it; a job
with very many events then ships one partial row per task.  ``callback_fold_stream``, ``stage_state_stream`` and
``stage_machine_stream`` keep keyed state that lapses.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from swathline.functions import constants as K
from swathline.functions.scalars import lookup
from swathline.operators.filters import next_stage, seconds_between

KNOWN_TYPES = ["progress", "complete", "error", "upload_status"]


def _last(value: Column, cond: Column) -> Column:
    """Value of the newest event that meets ``cond``."""
    return F.max_by(value, F.when(cond, F.struct("ts", "event_id")))


def _bad_upload() -> Column:
    return (F.col("type") == "upload_status") & (F.col("failed_types") != "")


def callback_fold(events: DataFrame, jobs: DataFrame | None = None) -> DataFrame:
    """Final state of each job from its callbacks (event_id, job_id, ts, type, progress, current_stage,
    stage_progress, error_message, failed_types as a comma list).

    Every field is the newest write to it, so one ordered-maximum aggregate replaces the sequential fold;
    NULL means the field was never written.  A progress callback without a number leaves the progress as it was.
    With ``jobs`` (job_id), callbacks of other jobs are left out (see ``callback_rejects``).  Works on a stream in update mode.
    """
    known = events.where(F.col("type").isin(KNOWN_TYPES))
    if jobs is not None:
        known = known.join(jobs.select("job_id").distinct(), "job_id", "left_semi")
    return known.groupBy("job_id").agg(
        F.count("*").alias("events"), *[_last(value, cond).alias(name) for name, (value, cond) in _callback_writes().items()])


def _callback_writes() -> dict[str, tuple[Column, Column]]:
    """Field of a job -> what a callback writes to it, and whether it does."""
    kind = F.col("type")
    prog, done, err, bad = kind == "progress", kind == "complete", kind == "error", _bad_upload()
    valid = prog & F.col("current_stage").isin(K.STAGES)
    # a finished stage is recorded even when its name is not a known one
    finished = prog & F.col("current_stage").isNotNull() & (F.col("current_stage") != "") & (F.col("stage_progress") == 100)
    names = F.concat(F.lit("Failed to upload products: "), F.regexp_replace("failed_types", ",", ", "))
    return {
        "progress": (F.when(done, F.lit(100)).otherwise(F.col("progress")), (prog & F.col("progress").isNotNull()) | done),
        "stage": (F.when(done, "completed").when(prog, F.col("current_stage")).otherwise("failed"), valid | done | err | bad),
        "status": (F.when(done, "completed").otherwise("failed"), done | err | bad),
        "error_message": (F.when(err, F.coalesce("error_message", F.lit("Unknown error"))).when(bad, names), done | err | bad),
        "last_successful_stage": (F.when(done, "completed").otherwise(F.col("current_stage")), finished | done),
        "completed_at": (F.col("ts"), done | err)}


def callback_rejects(events: DataFrame, jobs: DataFrame | None = None) -> DataFrame:
    """Callbacks of an unknown type, and with ``jobs`` (job_id) those of a job that isn't there."""
    strange = events.where(~F.coalesce(F.col("type").isin(KNOWN_TYPES), F.lit(False)))
    if jobs is None:
        return strange
    lost = events.where(F.col("type").isin(KNOWN_TYPES)).join(jobs.select("job_id").distinct(), "job_id", "left_anti")
    return strange.unionByName(lost.select(*strange.columns))


def running_status(events: DataFrame) -> DataFrame:
    """Newest finished stage per job, to resume from."""
    done = events.where((F.col("type") == "progress") & (F.col("stage_progress") == 100)
                        & F.col("current_stage").isNotNull())
    return done.groupBy("job_id").agg(
        F.max(F.struct("ts", "event_id", F.col("current_stage").alias("stage"))).alias("r")).select(
        "job_id", F.col("r.stage").alias("last_stage"), F.col("r.ts").alias("finished_at"))


def stage_durations(events: DataFrame, slot: str = "hour") -> DataFrame:
    """One row per completion (event_id, job_id, ts, stage, action): seconds since the newest start of that
    job and stage, and the stage that follows.

    An array column ``skipped`` of the events names stages that are passed over.
    The newest start before an event is a running maximum.  It runs inside (job, stage, time slot); what
    earlier slots contribute comes from one row per slot, so a job with very many events is not sorted whole.
    """
    from pyspark.sql import Window as W

    keys = ["job_id", "stage"]
    ev = events.withColumn("_slot", F.date_trunc(slot, "ts"))
    started = F.when(F.col("action") == "start", F.col("ts"))
    slots = ev.groupBy(*keys, "_slot").agg(F.max(started).alias("_last"))
    before = slots.withColumn("_carry", F.max("_last").over(
        W.partitionBy(*keys).orderBy("_slot").rowsBetween(W.unboundedPreceding, -1))).drop("_last")
    inner = F.max(started).over(W.partitionBy(*keys, "_slot").orderBy("ts", "event_id")
                                .rowsBetween(W.unboundedPreceding, 0))
    df = ev.withColumn("_inner", inner).join(before, [*keys, "_slot"])
    df = df.withColumn("_start", F.coalesce("_inner", "_carry"))
    took = seconds_between(F.col("ts"), F.col("_start"))
    return df.where("action = 'complete'").select(
        "event_id", "job_id", "stage", "ts", took.alias("duration_seconds"), _following(events).alias("next_stage"))


def _following(events: DataFrame) -> Column:
    """The stage after an event's, passing over those in its ``skipped`` where it has that column."""
    return next_stage(F.col("stage"), F.coalesce("skipped", F.array().cast("array<string>")) if "skipped" in events.columns else None)


def stage_machine(events: DataFrame) -> DataFrame:
    """Current state per job after all its stage events.

    Status: the newest start (running), failure (failed) or completion of the last stage (completed) decides.
    Stage and progress: the newest start gives its stage, the newest completion the stage that follows (passing over
    those in an array column ``skipped``).
    """
    events = events.withColumn("_next", _following(events))
    rec = F.struct("ts", "event_id", "action", "stage", "_next")
    ending = (F.col("action") == "complete") & (F.col("_next") == "completed")
    decisive = F.max(F.when((F.col("action") != "complete") | ending, rec)).alias("d")
    moved = F.max(F.when(F.col("action") != "fail", rec)).alias("m")
    per = events.groupBy("job_id").agg(F.max("ts").alias("updated_at"), decisive, moved)
    at = F.when(F.col("m.action") == "start", F.col("m.stage")).otherwise(F.col("m._next"))
    status = (F.when(F.col("d.action") == "fail", "failed").when(F.col("d.action") == "start", "running")
              .when(F.col("d.action") == "complete", "completed").otherwise("pending"))
    return per.select("job_id", status.alias("status"), at.alias("current_stage"),
                      lookup(at, K.STAGE_PROGRESS).alias("progress"), "updated_at")


def _newest_writes(fields: list[str], ttl_ms: int):
    """Per job: the newest write to each field, whatever order the events come in; lapses after the expiry.

    A frame has ts, event_id and for each field its value and, under ``_`` and the field's name, whether it is written.
    """

    def work(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        lapsed = state.hasTimedOut
        held = list(state.get) if lapsed or state.exists else [0, None] + [None] * (3 * len(fields))
        for pdf in () if lapsed else frames:  # one Arrow batch at a time: a job with very many events is never held whole
            micros = pdf["ts"].astype("datetime64[us]").astype("int64")
            held[0] += len(pdf)
            held[1] = int(micros.max()) if held[1] is None else max(held[1], int(micros.max()))
            for i, name in enumerate(fields):
                own = np.flatnonzero(pdf[f"_{name}"].to_numpy(dtype=bool))
                if len(own):
                    top = own[np.lexsort((pdf["event_id"].to_numpy()[own], micros.to_numpy()[own]))[-1]]
                    at = (int(micros.iloc[top]), int(pdf["event_id"].iloc[top]))
                    if held[2 + 3 * i] is None or at >= (held[2 + 3 * i], held[3 + 3 * i]):
                        value = pdf[name].iloc[top]
                        held[2 + 3 * i:5 + 3 * i] = [*at, None if pd.isna(value) else str(value)]
        if lapsed:
            state.remove()
        else:
            state.update(tuple(held))
            state.setTimeoutTimestamp(max(held[1] // 1000, state.getCurrentWatermarkMs()) + ttl_ms)
        yield pd.DataFrame({"job_id": [key[0]], "events": [held[0]], "updated": [held[1]], "expired": [lapsed],
                            **{name: pd.Series([held[4 + 3 * i]], dtype=object) for i, name in enumerate(fields)}})

    return work


def _held_state(events: DataFrame, writes: dict[str, tuple[Column, Column]], ttl_hours: int, delay: str) -> DataFrame:
    """(job_id, events, updated_at, expired, each field of ``writes`` as text), a row for each job that a batch touches or that lapses."""
    values = [c for name, (value, cond) in writes.items() for c in (
        value.cast("string").alias(name), F.coalesce(cond, F.lit(False)).alias(f"_{name}"))]
    kind, clock = events.schema["job_id"].dataType.simpleString(), events.schema["ts"].dataType
    timed = events.select("job_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").cast("long").alias("event_id"), *values)
    state = ", ".join(f"at_{i} long, id_{i} long, value_{i} string" for i in range(len(writes)))
    held = timed.withWatermark("ts", delay).groupBy("job_id").applyInPandasWithState(
        _newest_writes([*writes], ttl_hours * 3600 * 1000),
        f"job_id {kind}, events long, updated long, expired boolean, " + ", ".join(f"{name} string" for name in writes),
        f"events long, updated long, {state}", "update", GroupStateTimeout.EventTimeTimeout)
    return held.withColumn("updated", F.timestamp_micros("updated").cast(clock)).withColumnRenamed("updated", "updated_at")


def callback_fold_stream(events: DataFrame, ttl_hours: int = K.STATE_TTL_HOURS, delay: str = "1 hour") -> DataFrame:
    """Streaming twin of ``callback_fold`` whose state goes: update mode, one row for each job that a batch touches.

    A job's state lapses ``ttl_hours`` of event time after its last callback: its fields come out once more with ``expired``
    true, and callbacks that come afterwards start anew.  Events later than ``delay`` are dropped.
    """
    known = events.where(F.col("type").isin(KNOWN_TYPES))
    held = _held_state(known, _callback_writes(), ttl_hours, delay)
    return held.withColumns({"progress": F.col("progress").cast(events.schema["progress"].dataType),
                             "completed_at": F.col("completed_at").cast(events.schema["ts"].dataType)})


def stage_state_stream(events: DataFrame, ttl_hours: int = K.STATE_TTL_HOURS, delay: str = "1 hour") -> DataFrame:
    """Streaming twin of ``stage_machine`` (update mode): job_id, status, current_stage, progress, updated_at, expired.

    State lapses as in ``callback_fold_stream``.  Stages in an array column ``skipped`` are passed over.
    """
    held = _held_state(events, _stage_writes(events), ttl_hours, delay)
    return held.select("job_id", F.coalesce("status", F.lit("pending")).alias("status"), "current_stage",
                       lookup(F.col("current_stage"), K.STAGE_PROGRESS).alias("progress"), "updated_at", "expired")


def _stage_writes(events: DataFrame) -> dict[str, tuple[Column, Column]]:
    action, after = F.col("action"), _following(events)
    status = F.when(action == "fail", "failed").when(action == "start", "running").when(action == "complete", "completed").otherwise("pending")
    return {"status": (status, (action != "complete") | (after == "completed")),
            "current_stage": (F.when(action == "start", F.col("stage")).otherwise(after), action != "fail")}


NEVER = np.iinfo(np.int64).min


def _advance(ttl_ms: int, every: bool = False, following: bool = False):
    """Per job and stage: keep starts, emit a row per completion, lapse after the expiry.

    An event may come late: a completion counts from the newest start that isn't after it, and an older start
    never replaces a newer one.  ``every``: all starts are kept that an event still to come can count from (the newest before the
    watermark and those after it), else the newest alone.
    """
    columns = ["event_id", "action"] + (["next_stage"] if following else [])

    def work(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        began = np.array(state.get[0] if state.exists else [], np.int64)
        # one micro-batch of one stage of one job; the source's rate limit bounds it.  Plain arrays: there are very many small groups
        parts = [(pdf["ts"].to_numpy().astype("datetime64[us]").astype(np.int64), *(pdf[c].to_numpy() for c in columns)) for pdf in frames]
        micros, ids, action, *after = parts[0] if len(parts) == 1 else (np.concatenate(p) for p in zip(*parts, strict=True))
        order = np.lexsort((ids, micros))
        micros, action = micros[order], action[order]
        is_start, done = action == "start", action == "complete"
        at = micros[is_start]
        known = np.union1d(began, at)
        if done.any():
            # the newest start up to a completion: an old one that isn't later, or one before it in this batch
            finish = micros[done]
            place = np.searchsorted(began, finish, side="right") - 1
            newest = np.where(place >= 0, began[np.maximum(place, 0)], NEVER) if len(began) else np.full(len(finish), NEVER)
            count = np.cumsum(is_start)[done]
            if len(at):
                newest = np.maximum(newest, np.where(count > 0, at[np.maximum(count - 1, 0)], NEVER))
            took = np.where(newest > NEVER, (finish - newest) / 1e6, np.nan)
            out = {"event_id": ids[order][done], "job_id": key[0], "stage": key[1], "duration_seconds": took}
            out |= {"next_stage": a[order][done] for a in after}
        if len(known):
            mark = state.getCurrentWatermarkMs()
            first = max(int(np.searchsorted(known, mark * 1000, side="right")) - 1, 0) if every else len(known) - 1
            state.update((known[first:].tolist(),))
            state.setTimeoutTimestamp(max(int(max(micros[-1], known[-1])) // 1000, mark) + ttl_ms)
        if done.any():
            yield pd.DataFrame(out)

    return work


def stage_machine_stream(events: DataFrame, ttl_hours: int = K.STATE_TTL_HOURS, delay: str = "1 hour", following: bool = False) -> DataFrame:
    """Streaming twin of ``stage_durations``; state lapses ``ttl_hours`` of event time after the last write.

    With ``following`` the rows have ``next_stage`` too, passing over stages in an array column ``skipped``.  A start and a completion
    that both come after a newer start still pair up, as long as they are not later than ``delay``.
    """
    after = [_following(events).alias("next_stage")] if following else []
    timed = events.select("event_id", "job_id", F.col("ts").cast("timestamp").alias("ts"), "stage", "action", *after)
    return timed.withWatermark("ts", delay).groupBy("job_id", "stage").applyInPandasWithState(
        _advance(ttl_hours * 3600 * 1000, every=True, following=following),
        "event_id long, job_id long, stage string, duration_seconds double" + (", next_stage string" if following else ""),
        "started array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def dedupe_product(uploads: DataFrame) -> DataFrame:
    """One product per (dataset, job, type): later uploads replace fields they carry, and always the uri.

    ``uploads`` has dataset_id, job_id, type, order columns created_at, seq, revision, and fields uri, resolution_cm.
    """
    order = F.struct("created_at", "seq", "revision", F.coalesce("uri", F.lit("")), "resolution_cm")

    def newest(col: str) -> Column:
        return F.max_by(col, F.when(F.col(col).isNotNull(), order)).alias(col)

    return uploads.groupBy("dataset_id", "job_id", "type").agg(
        F.count("*").alias("versions"), F.max_by("uri", order).alias("uri"), newest("resolution_cm"),
        F.min("created_at").alias("created_at"))


PRODUCT_KEYS = ("dataset_id", "job_id", "type")


def product_parts(uploads: DataFrame) -> DataFrame:
    """``uploads`` (as in ``dedupe_product``) -> mergeable parts, one row for each upload."""
    order = F.struct("created_at", "seq", "revision", F.coalesce("uri", F.lit("")).alias("place"), F.col("resolution_cm").alias("size"))
    sized = F.when(F.col("resolution_cm").isNotNull(), F.struct(order.alias("at"), "resolution_cm"))
    return uploads.select(*PRODUCT_KEYS, F.lit(1).cast("long").alias("versions"), F.struct(order.alias("at"), "uri").alias("newest"),
                          sized.alias("sized"), "created_at")


def merge_products(parts: DataFrame) -> DataFrame:
    """Parts of the same product made one; merging in any order and grouping gives the same."""
    return parts.groupBy(*PRODUCT_KEYS).agg(F.sum("versions").alias("versions"), F.max("newest").alias("newest"),
                                            F.max("sized").alias("sized"), F.min("created_at").alias("created_at"))


def finish_products(parts: DataFrame) -> DataFrame:
    """Merged parts -> the columns of ``dedupe_product``."""
    return parts.select(*PRODUCT_KEYS, "versions", F.col("newest.uri").alias("uri"), F.col("sized.resolution_cm").alias("resolution_cm"), "created_at")
