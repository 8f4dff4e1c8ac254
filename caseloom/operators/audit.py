"""Audit jobs over event tables (R1 lockout, R2 latest valid token).

R1 -- lockout rule, per user, over attempts ordered by (ts, event_id):
  * an attempt while ``ts < locked_until`` is ignored;
  * a success resets the counter and clears the lock;
  * a failure adds 1; at ``max_failed`` or more the account locks until
    ``ts + lock_minutes``.  An expired lock does not reset the counter, so
    the next failure locks again at once.

Users with at most ``chunk_size`` attempts are folded by ``aggregate`` over
their sorted attempts.  A user with more is never gathered; the fold becomes a
path in a graph of failures, found by parallel prefix steps:

  1. attempts are numbered over all partitions and cut into chunks; scans run
     inside chunks and over one row a chunk: the length of the run of failures
     up to each attempt, and the next failure at which a run reaches
     ``max_failed`` ("fresh lock").
  2. the first lock is the first fresh one.  After a lock at p the first
     attempt with ``ts >= ts_p + lock_minutes`` decides: if it fails it is the
     next lock, else the next fresh one after it is.  So every failure has one
     successor, found for all at once by a sorted union of attempts and ends
     of locks.
  3. the locks are the path from the first one.  Successors are composed with
     themselves in every round (2, 4, 8, ... steps on), and the set of reached
     locks doubles with them: a logarithmic number of joins, each row of fixed
     size.

Everything is DataFrame code on the JVM.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window, functions as F

from caseloom.functions.dates import ntz
from caseloom.plans.lineage import cut_lineage
from caseloom.plans.numbering import global_row_number
from caseloom.schema import LOCKOUT_MINUTES, MAX_FAILED_ATTEMPTS

DEFAULT_CHUNK = 50_000
LOCKS_SCHEMA = "array<struct<ts:timestamp_ntz,locked_until:timestamp_ntz,attempts:bigint>>"


def _placed(attempts: DataFrame) -> DataFrame:
    return attempts.select("user_id", "event_id", "ts", "ok").filter(F.col("ts").isNotNull() & F.col("user_id").isNotNull())


def _fold(ev: DataFrame, max_failed: int, lock: Column) -> DataFrame:
    """user_id, attempts, locked_until and locks of users with few attempts."""
    none = F.lit(None).cast("timestamp_ntz")
    start = F.struct(F.lit(0).cast("long").alias("a"), none.alias("lu"), F.array().cast(LOCKS_SCHEMA).alias("locks"))

    def step(s: Column, x: Column) -> Column:
        until, many = x["ts"] + lock, s["a"] + 1
        hit = F.struct(x["ts"].alias("ts"), until.alias("locked_until"), many.alias("attempts"))
        locked = F.struct(many.alias("a"), until.alias("lu"), F.concat(s["locks"], F.array(hit)).alias("locks"))
        failed = F.when(many >= max_failed, locked).otherwise(F.struct(many.alias("a"), s["lu"].alias("lu"), s["locks"].alias("locks")))
        reset = F.struct(F.lit(0).cast("long").alias("a"), none.alias("lu"), s["locks"].alias("locks"))
        return F.when(s["lu"].isNotNull() & (x["ts"] < s["lu"]), s).when(x["ok"], reset).otherwise(failed)

    listed = ev.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "ok"))).alias("_x"))
    done = listed.select("user_id", F.aggregate("_x", start, step).alias("_s"))
    return done.select("user_id", F.col("_s.a").alias("attempts"), F.col("_s.lu").alias("locked_until"), F.col("_s.locks").alias("locks"))


def _scan(df: DataFrame, order: str, value: Column, out: str, following: bool) -> DataFrame:
    """``out``: the greatest ``value`` up to each row, or the least after it
    (``following``), over a user's rows in ``order``; ``chunk`` grows with it."""
    agg = F.min if following else F.max
    w = Window.partitionBy("user_id", "chunk").orderBy(order)
    w = w.rowsBetween(1, Window.unboundedFollowing) if following else w.rowsBetween(Window.unboundedPreceding, 0)
    over = Window.partitionBy("user_id").orderBy("chunk")
    over = over.rowsBetween(1, Window.unboundedFollowing) if following else over.rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_v", value)
    ends = df.groupBy("user_id", "chunk").agg(agg("_v").alias("_end")).withColumn("_carry", agg("_end").over(over)).drop("_end")
    out_col = F.coalesce(agg("_v").over(w), F.col("_carry"))
    return df.join(ends, ["user_id", "chunk"]).withColumn(out, out_col).drop("_v", "_carry")


def _chunked(df: DataFrame, order: list, out: str, chunk_size: int) -> DataFrame:
    """Numbered over all partitions, whatever a user's size, and cut."""
    df = global_row_number(df, order, out_col=out, partition_by=["user_id"], window_group_rows=0)
    return df.withColumn("chunk", F.floor((F.col(out) - 1) / chunk_size).cast("long"))


def lock_path(ev: DataFrame, max_failed: int, lock: Column, chunk_size: int) -> tuple[DataFrame, DataFrame]:
    """(locks, ends) of users with many attempts: every lock (user_id, n, ts,
    again: right after the one before), and each user's last attempt (user_id,
    run: failures in a row up to it)."""
    ev = cut_lineage(_chunked(ev, ["ts", "event_id"], "n", chunk_size))
    n = F.col("n")
    runs = _scan(ev, "n", F.when(F.col("ok"), n), "_ok", following=False).withColumn("run", n - F.coalesce("_ok", F.lit(0))).drop("_ok")
    runs = cut_lineage(_scan(runs, "n", F.when(~F.col("ok") & (F.col("run") == max_failed), n), "fresh", following=True))
    # the first attempt at or after the end of a lock at each failure
    ends = runs.filter(~F.col("ok")).select("user_id", (F.col("ts") + lock).alias("ts"), n.alias("p"))
    both = ends.select("user_id", "ts", "p", F.lit(None).cast("long").alias("n")).unionByName(runs.select("user_id", "ts", F.lit(None).cast("long").alias("p"), "n"))
    # an end stands before the attempts of its time
    both = _chunked(both, ["ts", F.coalesce("n", F.lit(0)), F.coalesce("p", F.lit(0))], "m", chunk_size)
    after = _scan(both, "m", n, "k", following=True).filter(F.col("p").isNotNull() & F.col("k").isNotNull()).select("user_id", "p", "k")
    at = runs.select("user_id", n.alias("k"), "ok", "fresh")
    hops = after.join(at, ["user_id", "k"]).select("user_id", "p", F.when(F.col("ok"), F.col("fresh")).otherwise(F.col("k")).alias("q"), (~F.col("ok")).alias("again"))
    hops = cut_lineage(hops.filter(F.col("q").isNotNull()))
    first = runs.filter(~F.col("ok") & (F.col("run") == max_failed)).groupBy("user_id").agg(F.min("n").alias("p"))
    reached, jump = cut_lineage(first), hops.select("user_id", "p", "q")
    while True:
        new = cut_lineage(reached.join(jump, ["user_id", "p"]).select("user_id", F.col("q").alias("p")))
        if new.isEmpty():
            break
        reached = reached.unionByName(new)
        jump = cut_lineage(jump.join(jump.select("user_id", F.col("p").alias("q"), F.col("q").alias("_r")), ["user_id", "q"]).select("user_id", "p", F.col("_r").alias("q")))
    # a lock that follows at once is the next of one on the path
    again = reached.join(hops.filter("again"), ["user_id", "p"]).select("user_id", F.col("q").alias("p"), F.lit(True).alias("again"))
    locks = reached.join(again, ["user_id", "p"], "left").withColumnRenamed("p", "n").join(runs.select("user_id", "n", "ts"), ["user_id", "n"])
    locks = locks.select("user_id", "n", "ts", F.coalesce("again", F.lit(False)).alias("again"))
    # what a last lock leaves: nothing after it, or a success that cleared it
    last = runs.groupBy("user_id").agg(F.max_by("run", "n").alias("run"), F.max("ts").alias("last_ts"))
    return locks, last


def lockout_states(attempts: DataFrame, max_failed: int = MAX_FAILED_ATTEMPTS,
                   lock_minutes: int = LOCKOUT_MINUTES, chunk_size: int = DEFAULT_CHUNK) -> DataFrame:
    """R1 core, one row a user: attempts and locked_until at the end, and the
    locks (ts, locked_until, attempts) in order; a user's locks are at least
    ``lock_minutes`` apart, so their number is bounded by time.  Attempts
    without a user (unknown accounts keep no counter) or without a time take
    no part; ``unplaced_attempts`` counts them."""
    lock = F.make_dt_interval(mins=F.lit(lock_minutes))
    ev = _placed(attempts)
    many = cut_lineage(ev.groupBy("user_id").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > chunk_size).select("user_id"))
    if many.isEmpty():
        return _fold(ev, max_failed, lock)
    few = _fold(ev.join(many, "user_id", "left_anti"), max_failed, lock)
    locks, last = lock_path(ev.join(many, "user_id", "left_semi"), max_failed, lock, chunk_size)
    by_n = Window.partitionBy("user_id").orderBy("n")
    # locks in a row add 1 to the counter, a fresh one starts at max_failed
    locks = locks.withColumn("_group", F.sum((~F.col("again")).cast("int")).over(by_n))
    count = F.row_number().over(Window.partitionBy("user_id", "_group").orderBy("n")) + (max_failed - 1)
    hit = F.struct("ts", (F.col("ts") + lock).alias("locked_until"), count.cast("long").alias("attempts"))
    locks = locks.select("user_id", hit.alias("_l")).groupBy("user_id").agg(F.array_sort(F.collect_list("_l")).cast(LOCKS_SCHEMA).alias("locks"))
    end = F.try_element_at("locks", F.lit(-1))
    open_ = F.coalesce(F.col("last_ts") < end["locked_until"], F.lit(False))
    hot = last.join(locks, "user_id", "left").select(
        "user_id", F.when(open_, end["attempts"]).otherwise(F.col("run")).alias("attempts"),
        F.when(open_, end["locked_until"]).alias("locked_until"), F.coalesce("locks", F.array().cast(LOCKS_SCHEMA)).alias("locks"))
    return few.unionByName(hot)


def unplaced_attempts(attempts: DataFrame) -> DataFrame:
    """One row (no_user, no_time), the attempts the lockout rule leaves
    out: without a user, and of a user but without a time."""
    no_user = F.col("user_id").isNull()
    return attempts.agg(F.count(F.when(no_user, 1)).alias("no_user"),
                        F.count(F.when(~no_user & F.col("ts").isNull(), 1)).alias("no_time"))


def lockout_events(attempts: DataFrame, **kw) -> DataFrame:
    """Every lock as (user_id, locked_at, locked_until, attempts)."""
    return lockout_states(attempts, **kw).select("user_id", F.explode("locks").alias("_l")).select(
        "user_id", F.col("_l.ts").alias("locked_at"), "_l.locked_until", "_l.attempts")


def lockout_audit(attempts: DataFrame, **kw) -> DataFrame:
    """R1 per user: final failed_attempts, final locked_until (kept after
    expiry, cleared by a success), number of locks, last lock time."""
    return lockout_states(attempts, **kw).select(
        "user_id", "attempts", "locked_until", F.size("locks").cast("long").alias("n_locks"),
        F.try_element_at("locks", F.lit(-1))["ts"].alias("last_lock"))


# ---------------------------------------------------------------------- R2


def latest_valid(tokens: DataFrame, as_of: dt.datetime, key=("email", "purpose"), supersede: bool = True
                 ) -> DataFrame:
    """R2: per key, the newest token that is unused and unexpired at
    ``as_of`` (issued at or before it).  With ``supersede`` a newer token of
    the same email voids older unused ones whatever their purpose, as a new
    request deletes them.  Newest-per-key is a ``max_by`` aggregate (partial
    before the shuffle), not a window, so a hot key is not gathered."""
    ts = ntz(as_of)
    issued = tokens.filter(F.col("created_at") <= ts)
    order = F.struct("created_at", "id")
    cand = issued.filter(~F.col("used") & (F.col("expires_at") > ts))
    if supersede:
        newest = issued.groupBy("email").agg(F.max(order).alias("_newest"))
        cand = (cand.join(newest, "email", "inner")
                    .filter(F.struct("created_at", "id") == F.col("_newest")).drop("_newest"))
    cols = [c for c in tokens.columns if c not in key]
    picked = cand.groupBy(*key).agg(F.max_by(F.struct(*cols), order).alias("_t"))
    return picked.select(*key, *[F.col(f"_t.{c}").alias(c) for c in cols]).select(*tokens.columns)
