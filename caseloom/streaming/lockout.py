"""R1 on a stream: the lockout rule as per-user state.

The fold depends on the order of attempts, so arrivals are not applied as
they come: ``transformWithState`` keeps per user, in RocksDB, the fold
state as a value and the attempts not yet applied as a list.  An attempt is
applied, in (ts, event_id) order, once the watermark has reached it; attempts
within the watermark delay may arrive in any order and still give the batch
result.  An event-time timer just before a user's earliest waiting attempt
releases it, so the attempt with the stream's largest time is applied too.

Nothing is dropped without a count.  The event-time column sets the watermark
and does not reach the stateful operator, so the engine filters no late rows:
an attempt at or before its user's last applied one is counted in ``late``, an
attempt without a time in ``no_time``, and attempts without a user in rows of
their own (``user_id`` NULL, dealt over ``LANES`` lanes by a hash, as they may
be many), in ``no_user``.

The few scalars of a user stay for good, as only a success resets them.

Most users have few attempts a micro-batch, so the cost is that of a user, not
of an attempt: rows go in and out as Rows (a DataFrame a user costs many times
the fold), and what waits is packed, up to ``PACKED`` attempts in one list
value, so that it is one call to the state store and not one value an attempt.
"""

from __future__ import annotations

import datetime as dt
import sys
from collections.abc import Iterator

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from caseloom.schema import LOCKOUT_MINUTES, MAX_FAILED_ATTEMPTS

# The functions below run in Python workers, which need not have this
# package installed: ship them by value rather than by module reference.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

LANES = 32
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTPUT_SCHEMA = ("user_id long, lane int, attempts long, locked_until timestamp_ntz, n_locks long, last_lock timestamp_ntz, "
                 "late long, no_time long, no_user long, pending long, applied long, version long")
#: Times are microseconds; NULL stands for none.
STATE_SCHEMA = ("attempts long, locked_until long, n_locks long, last_lock long, last_ts long, last_id long, late long, "
                "no_time long, no_user long, pending long, applied long, next_ts long, version long")
WAITING_SCHEMA = "packed binary"
WAITING = np.dtype([("ts", "<i8"), ("event_id", "<i8"), ("ok", "?")])
#: Attempts in one value of the waiting list.
PACKED = 8192
_FIELDS = [c.split()[0] for c in STATE_SCHEMA.split(", ")]
_COLS = [c.split()[0] for c in OUTPUT_SCHEMA.split(", ")]


def _packed(attempts: np.ndarray) -> list[tuple[bytes]]:
    return [(attempts[i:i + PACKED].tobytes(),) for i in range(0, len(attempts), PACKED)]


class LockoutProcessor(StatefulProcessor):
    """The lockout rule for one (user_id, lane)."""

    def __init__(self, max_failed: int, lock_us: int):
        self.max_failed, self.lock_us = max_failed, lock_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("user", STATE_SCHEMA)
        self.waiting = handle.getListState("waiting", WAITING_SCHEMA)

    def _load(self) -> dict:
        kept = self.state.get()
        if kept is not None:
            return dict(zip(_FIELDS, kept))
        return dict.fromkeys(_FIELDS, 0) | dict.fromkeys(("locked_until", "last_lock", "last_ts", "last_id", "next_ts"))

    def _store(self, key, s: dict, timer: int | None) -> Iterator[Row]:
        """Keeps the state, moves the timer (``timer`` is the one set so far)
        and gives the user's row; Arrow takes its times as microseconds."""
        wanted = None if s["next_ts"] is None else s["next_ts"] // 1000 - 1
        if wanted != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if wanted is not None:
                self.handle.registerTimer(wanted)
        s["version"] += 1
        self.state.update(tuple(s[c] for c in _FIELDS))
        row = s | {"user_id": None if key[1] else key[0], "lane": key[1]}
        yield Row(**{c: row[c] for c in _COLS})

    def _apply(self, s: dict, due: np.ndarray) -> None:
        for at in range(0, len(due), PACKED):
            for t, eid, ok in due[at:at + PACKED].tolist():
                if s["last_ts"] is not None and (t, eid) <= (s["last_ts"], s["last_id"]):
                    s["late"] += 1
                    continue
                s["last_ts"], s["last_id"] = t, eid
                s["applied"] += 1
                if s["locked_until"] is not None and t < s["locked_until"]:
                    continue
                if ok:
                    s["attempts"], s["locked_until"] = 0, None
                    continue
                s["attempts"] += 1
                if s["attempts"] >= self.max_failed:
                    s["locked_until"], s["last_lock"], s["n_locks"] = t + self.lock_us, t, s["n_locks"] + 1

    def _release(self, s: dict, new: np.ndarray, watermark_ms: int) -> None:
        """Applies what the watermark has reached; the rest waits.  The list
        is read only if something in it is due."""
        limit = watermark_ms * 1000 + 999  # the watermark is in whole milliseconds
        waits = s["next_ts"]
        if waits is not None and waits <= limit:
            held = np.concatenate([np.frombuffer(x[0], WAITING) for x in self.waiting.get()] + [new])
            rest = held[held["ts"] > limit]
            self.waiting.put(_packed(rest)) if len(rest) else self.waiting.clear()
            waits = None
        else:
            held, rest = new, new[new["ts"] > limit]
            if len(rest):
                self.waiting.appendList(_packed(rest))
        due = held[held["ts"] <= limit]
        self._apply(s, due[np.lexsort((due["ok"], due["event_id"], due["ts"]))])
        s["pending"] += len(new) - len(due)
        first = int(rest["ts"].min()) if len(rest) else None
        s["next_ts"] = first if waits is None else waits if first is None else min(first, waits)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        s = self._load()
        timer = None if s["next_ts"] is None else s["next_ts"] // 1000 - 1
        parts, new = [], []
        for r in rows:
            if key[1]:
                s["no_user"] += 1
            elif r.ts is None:
                s["no_time"] += 1
            else:
                new.append((r.ts, r.event_id, r.ok))
                if len(new) == PACKED:
                    parts.append(np.array(new, WAITING))
                    new = []
        self._release(s, np.concatenate([*parts, np.array(new, WAITING)]), timerValues.getCurrentWatermarkInMs())
        yield from self._store(key, s, timer)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        s = self._load()
        timer = None if s["next_ts"] is None else s["next_ts"] // 1000 - 1
        if timer == expiredTimerInfo.getExpiryTimeInMs():
            timer = None  # the engine takes away the timer that fired
        self._release(s, np.array([], WAITING), timerValues.getCurrentWatermarkInMs())
        yield from self._store(key, s, timer)

    def close(self) -> None:
        pass


def lockout_stream(attempts: DataFrame, watermark: str = "10 minutes", max_failed: int = MAX_FAILED_ATTEMPTS,
                   lock_minutes: int = LOCKOUT_MINUTES, output_mode: str = "update") -> DataFrame:
    """Streaming R1: the lockout state of each user whenever it changes, with
    what waits (``pending``), was applied, came late or can't be placed;
    ``version`` orders a user's rows, so ``append`` output into a file sink
    keeps them all.  Needs the RocksDB state store (``start_lockout_stream``
    sets it)."""
    lock_us = int(dt.timedelta(minutes=lock_minutes).total_seconds() * 1e6)
    # the watermark needs a zoned timestamp: the NTZ wall clock read as UTC,
    # whatever the session zone (ts itself stays NTZ for the fold)
    ts = F.col("ts")
    event_time = F.make_timestamp(F.year(ts), F.month(ts), F.dayofmonth(ts), F.hour(ts), F.minute(ts),
                                  F.date_part(F.lit("SECOND"), ts), F.lit("UTC"))
    # keys and ids are never NULL: lane 0 is that of users, an attempt without an id is the first of its time
    lane = F.when(F.col("user_id").isNull(), F.pmod(F.xxhash64("event_id", "ts"), F.lit(LANES)) + 1).otherwise(0).cast("int")
    timed = attempts.withColumn("event_time", event_time).withWatermark("event_time", watermark)
    sent = timed.select(F.coalesce("user_id", F.lit(0)).alias("user_id"), lane.alias("lane"),
                        F.coalesce("event_id", F.lit(-(2**63))).alias("event_id"), F.unix_micros("event_time").alias("ts"), F.coalesce("ok", F.lit(False)).alias("ok"))
    return sent.groupBy("user_id", "lane").transformWithState(
        LockoutProcessor(max_failed, lock_us), OUTPUT_SCHEMA, output_mode, "EventTime")


def start_lockout_stream(attempts: DataFrame, sink_format: str = "parquet", path: str | None = None,
                         name: str = "lockout", available_now: bool = False, checkpoint: str | None = None, **kw):
    """Start the stream with its checkpoint in a folder of its name below the
    session's shared checkpoint folder (or in ``checkpoint``): the same name
    finds it again, so a restarted driver or lost executors resume from the
    committed state.  File sinks receive every state version in
    ``append`` mode (``lockout_stream_final`` picks each user's last);
    the memory sink keeps ``update`` rows."""
    from caseloom.plans.lineage import checkpoint_dir

    spark = attempts.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or checkpoint_dir(spark)
    ckpt = checkpoint or f"{base.rstrip('/')}/streams/{name}"
    # a started query keeps the settings of its start, so the session's own provider comes back
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKSDB)
    try:
        mode = "update" if sink_format == "memory" else "append"
        writer = lockout_stream(attempts, output_mode=mode, **kw).writeStream.outputMode(mode).format(sink_format)
        writer = writer.queryName(name) if sink_format == "memory" else writer.option("path", path)
        writer = writer.option("checkpointLocation", ckpt)
        if available_now:
            writer = writer.trigger(availableNow=True)  # process what is there, then stop
        return writer.start()
    finally:
        spark.conf.set(key, before)


def _last(updates: DataFrame) -> DataFrame:
    """The last row of every (user_id, lane): a ``max_by`` aggregate, partial before the shuffle."""
    cols = [c for c in _COLS if c not in ("user_id", "lane")]
    return updates.groupBy("user_id", "lane").agg(F.max_by(F.struct(*cols), "version").alias("_s")).select("user_id", "lane", "_s.*")


def lockout_stream_final(updates: DataFrame) -> DataFrame:
    """Last state per user that any attempt was applied for or waits."""
    return _last(updates).filter(F.col("user_id").isNotNull() & (F.col("applied") + F.col("pending") > 0)).drop("lane", "no_user")


def lockout_stream_counts(updates: DataFrame) -> DataFrame:
    """One row: attempts applied, pending, late, without a time (of a user),
    and without a user; together all that arrived."""
    return _last(updates).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("applied", "pending", "late", "no_time", "no_user")])
