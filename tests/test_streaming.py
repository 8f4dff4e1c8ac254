import datetime as dt
import os

from caseloom.operators import audit
from caseloom.plans.lineage import staging_path
from caseloom.schema import ATTEMPTS
from caseloom.streaming import lockout_stream_counts, lockout_stream_final, start_lockout_stream

T0 = dt.datetime(2025, 1, 1, 9, 0)
SEQ = [(0, False), (1, False), (2, False), (10, False), (40, False), (60, True), (80, True), (81, False)]
FLUSH_USER = 999


def _run(spark, tmp_dir, batches, name, watermark="10 minutes"):
    """Feed ``batches`` as successive micro-batches, then one attempt of
    another user a day later, which moves the watermark past everything."""
    src = os.path.join(tmp_dir, "src")
    flush = spark.createDataFrame([(10**9, FLUSH_USER, T0 + dt.timedelta(days=1), True)], ATTEMPTS)
    for i, b in enumerate(list(batches) + [flush]):
        b.coalesce(1).write.parquet(f"{src}/b{i:02d}")
    stream = (spark.readStream.schema(ATTEMPTS).option("maxFilesPerTrigger", 1)
                   .option("recursiveFileLookup", "true").parquet(src))
    q = start_lockout_stream(stream, "memory", name=name, checkpoint=staging_path(spark, name), watermark=watermark)
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    out = spark.sql(f"SELECT * FROM {name}").toPandas()
    return out[out.user_id != FLUSH_USER].groupby("user_id").last()


def _rows(users=(1, 2)):
    rows = []
    for u in users:
        for j, (m, ok) in enumerate(SEQ):
            rows.append((u * 100 + j, u, T0 + dt.timedelta(minutes=m, seconds=u), ok))
    return rows


def test_stream_matches_batch(spark, tmp_dir):
    df = spark.createDataFrame(_rows(), ATTEMPTS)
    cut = T0 + dt.timedelta(minutes=45)
    latest = _run(spark, tmp_dir, [df.filter(df.ts < cut), df.filter(df.ts >= cut)], "lockout_ok")
    batch = {r.user_id: r for r in audit.lockout_audit(df).collect()}
    for uid, r in batch.items():
        assert latest.loc[uid, "attempts"] == r.attempts
        assert latest.loc[uid, "n_locks"] == r.n_locks == 2
        assert latest.loc[uid, "late"] == 0 and latest.loc[uid, "pending"] == 0


def test_out_of_order_within_delay(spark, tmp_dir):
    # the failures at minutes 1 and 2 arrive after minute 10 and 40, within
    # a 60 minute watermark delay: the result equals the ordered fold
    df = spark.createDataFrame(_rows(users=(1,)), ATTEMPTS)
    early = df.filter("event_id IN (100, 103, 104)")
    rest = df.filter("event_id NOT IN (100, 103, 104)")
    latest = _run(spark, tmp_dir, [early, rest], "lockout_ooo", watermark="60 minutes")
    r = audit.lockout_audit(df).collect()[0]
    assert (latest.loc[1, "attempts"], latest.loc[1, "n_locks"]) == (r.attempts, r.n_locks) == (1, 2)


def test_start_stream_into_parquet(spark, tmp_dir):
    from caseloom.streaming import start_lockout_stream
    df = spark.createDataFrame(_rows(users=(1,)), ATTEMPTS)
    flush = spark.createDataFrame([(10**9, FLUSH_USER, T0 + dt.timedelta(days=1), True)], ATTEMPTS)
    src = os.path.join(tmp_dir, "src")
    df.coalesce(1).write.parquet(src + "/b0")
    flush.coalesce(1).write.parquet(src + "/b1")
    stream = (spark.readStream.schema(ATTEMPTS).option("maxFilesPerTrigger", 1)
                   .option("recursiveFileLookup", "true").parquet(src))
    q = start_lockout_stream(stream, "parquet", os.path.join(tmp_dir, "out"), name="lockout_pq", checkpoint=os.path.join(tmp_dir, "ck"))
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    from caseloom.streaming import lockout_stream_final
    out = lockout_stream_final(spark.read.parquet(os.path.join(tmp_dir, "out"))).filter("user_id = 1").collect()
    assert (out[0].attempts, out[0].n_locks, out[0].pending) == (1, 2, 0)


def test_restart_keeps_output_and_long_idle_users(spark, tmp_dir):
    """Two failures, four idle days, then a third one after a restart: the
    counter goes on, and the new user's rows reach the folder."""
    from caseloom.streaming import lockout_stream_final, start_lockout_stream
    src, out = os.path.join(tmp_dir, "src"), os.path.join(tmp_dir, "out")
    day = dt.timedelta(days=1)
    steps = [[(1, 1, T0, False), (2, 1, T0 + dt.timedelta(minutes=1), False)], [(3, FLUSH_USER, T0 + 2 * day, True)],
             [(4, 1, T0 + 4 * day, False), (5, 2, T0 + 4 * day, False)], [(6, FLUSH_USER, T0 + 9 * day, True)]]
    for i, rows in enumerate(steps):
        spark.createDataFrame(rows, ATTEMPTS).coalesce(1).write.parquet(f"{src}/b{i}")
        if i % 2 == 0:
            continue
        stream = (spark.readStream.schema(ATTEMPTS).option("maxFilesPerTrigger", 1)
                  .option("recursiveFileLookup", "true").parquet(src))
        q = start_lockout_stream(stream, "parquet", out, checkpoint=os.path.join(tmp_dir, "ck"))
        try:
            q.processAllAvailable()
        finally:
            q.stop()
    got = {r.user_id: r for r in lockout_stream_final(spark.read.parquet(out)).collect()}
    assert (got[1].attempts, got[1].n_locks) == (3, 1) and got[2].attempts == 1


def _through(spark, tmp_dir, batches, watermark="0 seconds", name="x"):
    """What the stream makes of ``batches``, one micro-batch each, with no
    further attempt after the last."""
    src, out = os.path.join(tmp_dir, name + "-src"), os.path.join(tmp_dir, name + "-out")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, ATTEMPTS).coalesce(1).write.parquet(f"{src}/b{i:02d}")
    stream = spark.readStream.schema(ATTEMPTS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(src)
    q = start_lockout_stream(stream, "parquet", out, checkpoint=os.path.join(tmp_dir, name + "-ck"), available_now=True, watermark=watermark)
    q.awaitTermination()
    return spark.read.parquet(out)


def test_odd_attempts_are_counted_and_do_not_stop_the_stream(spark, tmp_dir):
    rows = _rows()
    odd = [(900, 1, None, False), (901, None, T0, False), (902, None, None, True), (903, 3, None, False), (904, None, T0 + dt.timedelta(hours=1), False)]
    updates = _through(spark, tmp_dir, [rows[:5] + odd, rows[5:]])
    got = {r.user_id: r for r in lockout_stream_final(updates).collect()}
    batch = {r.user_id: r for r in audit.lockout_audit(spark.createDataFrame(rows + odd, ATTEMPTS)).collect()}
    assert got.keys() == batch.keys() == {1, 2}
    for u, r in batch.items():
        assert (got[u].attempts, got[u].locked_until, got[u].n_locks, got[u].last_lock) == (r.attempts, r.locked_until, r.n_locks, r.last_lock)
    left_out = audit.unplaced_attempts(spark.createDataFrame(odd, ATTEMPTS)).first()
    counts = lockout_stream_counts(updates).first()
    assert (counts.no_user, counts.no_time) == (left_out.no_user, left_out.no_time) == (3, 2)
    assert (counts.applied, counts.pending, counts.late) == (len(rows), 0, 0)


def test_attempt_of_the_largest_time_is_applied(spark, tmp_dir):
    last = T0 + dt.timedelta(hours=3, microseconds=1700)
    updates = _through(spark, tmp_dir, [[(1, 1, T0, False), (2, 7, last, False)]])
    got = {r.user_id: r for r in lockout_stream_final(updates).collect()}
    assert (got[7].attempts, got[7].applied, got[7].pending) == (1, 1, 0)


def test_late_attempts_are_counted(spark, tmp_dir):
    m = lambda i, u, minute: (i, u, T0 + dt.timedelta(minutes=minute), False)
    updates = _through(spark, tmp_dir, [[m(1, 1, 0), m(2, 1, 50)], [m(3, 2, 55)], [m(4, 1, 20), m(5, 1, 50), m(6, 2, 10), m(7, 3, 1)], [m(8, 1, 60)]])
    counts = lockout_stream_counts(updates).first()
    # 4 stands before its user's last applied attempt; 5 has the next event_id at the same time; 6 comes while its
    # user's only attempt still waits, and 7 is its user's first: both are in order for the user
    assert (counts.late, counts.applied, counts.pending) == (1, 7, 0)


class _Handle:
    """State and timers of one user, and the calls that reach the store."""

    def __init__(self):
        self.value, self.values, self.timers, self.calls = None, [], set(), 0

    def getValueState(self, *_):
        return self

    def getListState(self, *_):
        return _Waiting(self)

    def exists(self):
        self.calls += 1
        return self.value is not None

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value

    def registerTimer(self, ms):
        self.calls += 1
        self.timers.add(ms)

    def deleteTimer(self, ms):
        self.calls += 1
        self.timers.remove(ms)


class _Waiting:
    def __init__(self, handle):
        self.h = handle

    def get(self):
        self.h.calls += 1
        return iter(self.h.values)

    def appendList(self, values):
        self.h.calls += 1
        self.h.values = self.h.values + list(values)

    def put(self, values):
        self.h.calls += 1
        self.h.values = list(values)

    def clear(self):
        self.h.calls += 1
        self.h.values = []


class _Watermark:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def _fired(p, h, watermark_ms):
    """Fires the user's timers as the engine does; the last row given."""
    from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo
    last = None
    for ms in sorted(t for t in h.timers if t < watermark_ms):
        for last in p.handleExpiredTimer((1, 0), _Watermark(watermark_ms), ExpiredTimerInfo(ms)):
            pass
        h.timers.discard(ms)
    return last


def _processor():
    from caseloom.streaming.lockout import LockoutProcessor
    p, h = LockoutProcessor(3, 30 * 60 * 10**6), _Handle()
    p.init(h)
    return p, h


def _input(rows):
    from pyspark.sql import Row
    return iter([Row(user_id=1, lane=0, event_id=i, ts=t, ok=ok) for i, t, ok in rows])


def test_waiting_attempts_are_one_value_and_few_calls():
    """A user's attempts of a micro-batch wait in one list value, whatever
    their number below ``PACKED``, and take a fixed number of store calls."""
    calls = []
    for n in (3, 300):
        p, h = _processor()
        rows = [(i, i * 60 * 10**6, i % 4 == 3) for i in range(n)]
        (first,) = p.handleInputRows((1, 0), _input(rows), _Watermark(-1))
        assert (first.pending, first.applied, len(h.values)) == (n, 0, 1)
        last = _fired(p, h, 10**9)
        assert (last.pending, last.applied, h.values, h.timers) == (0, n, [], set())
        calls.append(h.calls)
    assert calls[0] == calls[1] <= 8


def test_packed_waiting_attempts_equal_the_ordered_fold(monkeypatch):
    """Many packed values, arrivals in any order within the delay, partial
    releases: the state is that of the fold in (ts, event_id) order."""
    import random

    from caseloom.streaming import lockout
    monkeypatch.setattr(lockout, "PACKED", 7)
    minute = 60 * 10**6
    for seed in range(20):
        rnd = random.Random(seed)
        t, rows = 0, []
        for i in range(200):
            t += rnd.choice([0, 0, minute, 9 * minute, 31 * minute])
            rows.append((i, t, rnd.random() < 0.2))
        arrived = sorted(rows, key=lambda r: r[1] + rnd.randint(0, 40 * minute))
        p, h = _processor()
        top, watermark = 0, -1
        for at in range(0, len(rows), 23):
            batch = arrived[at:at + 23]
            list(p.handleInputRows((1, 0), _input(batch), _Watermark(watermark)))
            _fired(p, h, watermark)
            top = max([top] + [r[1] for r in batch])
            watermark = max(watermark, (top - 41 * minute) // 1000)
        last = _fired(p, h, t // 1000 + 10**6)
        a, lu, locks, last_lock = 0, None, 0, None
        for _, ts, ok in rows:
            if lu is not None and ts < lu:
                continue
            if ok:
                a, lu = 0, None
                continue
            a += 1
            if a >= 3:
                lu, locks, last_lock = ts + 30 * minute, locks + 1, ts
        assert (last.attempts, last.locked_until, last.n_locks, last.last_lock) == (a, lu, locks, last_lock)
        assert (last.applied, last.late, last.pending) == (200, 0, 0)


def test_user_with_more_attempts_than_one_packed_value(spark, tmp_dir):
    from caseloom.streaming.lockout import PACKED
    n = PACKED + 500
    rows = [(i, 1 + i % 50 // 49, T0 + dt.timedelta(seconds=7 * (i * 7919 % n), microseconds=i % 3), i % 11 == 0) for i in range(n)]
    updates = _through(spark, tmp_dir, [rows])
    got = {r.user_id: r for r in lockout_stream_final(updates).collect()}
    for r in audit.lockout_audit(spark.createDataFrame(rows, ATTEMPTS)).collect():
        assert (got[r.user_id].attempts, got[r.user_id].locked_until, got[r.user_id].n_locks, got[r.user_id].last_lock) == (r.attempts, r.locked_until, r.n_locks, r.last_lock)
    assert sum(r.applied for r in got.values()) == n


def test_counts_of_packed_late_and_unplaced_attempts(monkeypatch):
    """What waited, came late or can't be placed is counted once, however the
    waiting attempts are packed; attempts that can't be placed never wait."""
    from pyspark.sql import Row

    from caseloom.streaming import lockout
    monkeypatch.setattr(lockout, "PACKED", 4)
    minute = 60 * 10**6
    p, h = _processor()
    list(p.handleInputRows((1, 0), _input([(i, i * minute, False) for i in range(10)] + [(90, None, False), (91, None, True)]), _Watermark(-1)))
    assert len(h.values) == 3
    _fired(p, h, 6 * 60_000)
    (row,) = p.handleInputRows((1, 0), _input([(92, 2 * minute, True), (93, 8 * minute, False)]), _Watermark(6 * 60_000))
    assert (row.applied, row.pending, row.late, row.no_time) == (7, 4, 1, 2)
    row = _fired(p, h, 60 * 60_000)
    assert (row.applied, row.pending, row.late, row.no_time, row.no_user) == (11, 0, 1, 2, 0)

    p, h = _processor()
    (row,) = p.handleInputRows((0, 5), iter([Row(user_id=0, lane=5, event_id=i, ts=None, ok=False) for i in range(9)]), _Watermark(-1))
    assert (row.user_id, row.lane, row.no_user, row.no_time, h.values, h.timers) == (None, 5, 9, 0, [], set())
