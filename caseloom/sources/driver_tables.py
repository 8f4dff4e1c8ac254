"""Case-log tables derived from the driver's TPC-H-like tables.

The driver data holds no case log; these views derive one (and the user,
grant, import, login-attempt, token and change tables) with fixed rules so
that Spark and the DuckDB oracle (``driver_sql``) compute the same input.
All derivations are lazy DataFrames over the whole tables.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F

from caseloom.functions.dates import ntz

PLACEHOLDER = "--- Please Select ---"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _k(mod: int) -> F.Column:
    return (F.col("o_orderkey") % mod) == 0


def customer_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer -> home site code (nation -> region)."""
    geo = (table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"),
                                               F.col("n_regionkey") == F.col("r_regionkey"))
           .select("n_nationkey", F.lower("r_name").alias("location")))
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal",
                                                    "c_mktsegment")
    return cust.join(geo, F.col("c_nationkey") == F.col("n_nationkey")).drop(
        "n_nationkey", "c_nationkey")


def _first_line_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per order: p_name / p_type of the line with the lowest
    (l_linenumber, l_partkey).  A min over a struct aggregates partially
    before the shuffle, so a hot order key costs no more than a cold one."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    first = (lines.groupBy("l_orderkey")
                  .agg(F.min(F.struct("l_linenumber", "l_partkey")).alias("_first"))
                  .select("l_orderkey", F.col("_first.l_partkey").alias("first_partkey")))
    part = (table(spark, sf_dir, "part").groupBy("p_partkey")
            .agg(F.min("p_name").alias("p_name"), F.min("p_type").alias("p_type")))
    return (first.join(part, F.col("first_partkey") == F.col("p_partkey"), "left")
                 .select(F.col("l_orderkey").alias("d_orderkey"), "p_name", "p_type"))


def _resolver_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per order: sorted distinct supplier names of its lines, ', '-joined.
    Lines meet suppliers first; one aggregate per order then dedupes the
    names (``collect_set`` is partial, so duplicates drop before the
    shuffle)."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    supp = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    return (lines.join(supp, F.col("l_suppkey") == F.col("s_suppkey"))
                 .groupBy("l_orderkey")
                 .agg(F.array_join(F.array_sort(F.collect_set("s_name")), ", ").alias("names"))
                 .withColumnRenamed("l_orderkey", "r_orderkey"))


def cases_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The case log (``caseloom.schema.CASES`` columns) over orders.

    The two line-derived parts are left joins of aggregates keyed by the
    order key; Catalyst drops them from any query that does not use their
    columns.
    """
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate",
                                               "o_orderpriority")
    base = o.join(customer_sites(spark, sf_dir), F.col("o_custkey") == F.col("c_custkey"))
    base = base.join(_first_line_detail(spark, sf_dir), F.col("o_orderkey") == F.col("d_orderkey"), "left")
    base = base.join(_resolver_names(spark, sf_dir), F.col("o_orderkey") == F.col("r_orderkey"), "left")
    key = F.col("o_orderkey")
    return base.select(
        key.alias("id"),
        F.when(_k(7), F.concat(F.lit("C-"), key.cast("string"))).otherwise(key.cast("string")).alias("case_no"),
        F.when(_k(53), F.lit(None).cast("date")).otherwise(F.to_date("o_orderdate")).alias("case_date"),
        F.when(_k(41), F.lit(None).cast("string")).otherwise(F.col("o_orderpriority")).alias("issues"),
        F.col("p_name").alias("description"),
        F.col("p_type").alias("step_to_resolve"),
        F.col("c_name").alias("opened_by"),
        F.when(_k(37), F.lit(None).cast("string")).when(_k(31), F.lit("")).otherwise(F.col("c_mktsegment"))
         .alias("department"),
        F.when(F.col("o_orderstatus") == "F", F.lit("Completed"))
         .when(F.col("o_orderstatus") == "O", F.lit("In progress"))
         .otherwise(F.lit("Pending")).alias("status"),
        F.when(_k(29), F.lit(PLACEHOLDER)).otherwise(F.col("names")).alias("resolved_by"),
        F.lit(None).cast("string").alias("remark"),
        F.col("o_orderdate").alias("created_at"),
        F.col("o_orderdate").alias("updated_at"),
        F.col("location"),
    )


def locations_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "region")
    return r.select(F.lower("r_name").alias("code"), F.col("r_name").alias("name"),
                    F.substring("r_name", 1, 3).alias("short_name"))


def users_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    m20 = k % 20
    locked = F.col("c_acctbal") < 0
    return c.select(
        k.alias("id"),
        F.col("c_name").alias("eid"),
        F.concat(F.lit("user"), k.cast("string"), F.lit("@example.com")).alias("email"),
        F.when(k % 5 == 0, F.lit(None).cast("string")).when(k % 11 == 0, F.lit(""))
         .otherwise(F.concat(F.lit("Agent "), k.cast("string"))).alias("full_name"),
        F.when(m20 == 0, F.lit("superadmin")).when(m20 <= 3, F.lit("admin")).otherwise(F.lit("user")).alias("role"),
        locked.alias("is_locked"),
        F.when(locked, ntz(dt.datetime(2024, 1, 15, 12, 0)))
         .otherwise(F.lit(None).cast("timestamp_ntz")).alias("locked_until"),
        F.when(locked, F.lit(3)).otherwise(k % 3).cast("long").alias("failed_attempts"),
    )


def grants_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Home site of each customer plus the site ``custkey % 5``, distinct."""
    home = customer_sites(spark, sf_dir).select(F.col("c_custkey").alias("user_id"),
                                                F.col("location").alias("location_code"))
    region = table(spark, sf_dir, "region").select("r_regionkey", F.lower("r_name").alias("location_code"))
    second = (table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))
              .join(region, (F.col("user_id") % 5) == F.col("r_regionkey"))
              .select("user_id", "location_code"))
    g = home.unionByName(second).distinct()
    u = F.col("user_id")
    return g.select("user_id", "location_code", (u % 7 != 0).alias("can_view"), (u % 2 == 0).alias("can_edit"),
                    (u % 3 == 0).alias("can_delete"))


def import_raw_view(spark: SparkSession, sf_dir: str, with_status: bool = True,
                    with_extra: bool = True) -> DataFrame:
    """A worksheet as it arrives: every cell text, headers as in the sheet."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    d = F.to_date("o_orderdate")
    blank = k % 11 == 0
    m6 = k % 6
    date_text = (F.when(blank, F.lit(None).cast("string"))
                  .when(m6 == 0, F.date_format(d, "yyyy-MM-dd"))
                  .when(m6 == 1, F.date_format(d, "d-MMM-yy"))
                  .when(m6 == 2, F.date_format(d, "dd/MM/yyyy"))
                  .when(m6 == 3, F.date_format(d, "MM/dd/yyyy"))
                  .when(m6 == 4, F.date_format(d, "d-M-yyyy"))
                  .otherwise(F.lit("garbage")))
    cols = [
        F.when(k % 17 == 0, F.lit(None).cast("string")).when(k % 19 == 0, F.lit("0"))
         .when(k % 23 == 0, F.lit("")).when(k % 2 == 0, F.concat(k.cast("string"), F.lit(".0")))
         .otherwise(k.cast("string")).alias("No."),
        date_text.alias("Date"),
        F.when(blank, F.lit("")).otherwise(F.col("o_orderpriority")).alias("Issues"),
        F.when(blank, F.lit("  ")).otherwise(F.concat(F.lit("Order "), k.cast("string"))).alias("Description"),
        F.when(k % 3 == 0, F.lit("Restart")).otherwise(F.lit(None).cast("string")).alias("Step to Resolve"),
        F.when(blank, F.lit(None).cast("string")).otherwise(F.col("o_custkey").cast("string")).alias("Opened by"),
        F.when(blank, F.lit(" ")).otherwise(F.col("o_orderstatus")).alias("Department"),
    ]
    if with_status:
        cols.append(F.when(F.col("o_orderstatus") == "F", F.lit("Completed"))
                     .when(F.col("o_orderstatus") == "O", F.lit("In progress"))
                     .otherwise(F.lit(None).cast("string")).alias("Status"))
    cols += [
        F.when(k % 4 == 0, F.lit("a1, b2")).otherwise(F.lit(None).cast("string")).alias("Resolved by"),
        F.lit(None).cast("string").alias("Remark"),
    ]
    if with_extra:
        cols.append(F.lit("x").alias("Extra"))
    cols.append(k.alias("_row"))
    return o.select(*cols)


def _attempts(e: DataFrame) -> DataFrame:
    i = F.col("event_id")
    return (e.filter(F.col("event_type").isin("error", "click"))
             .select("event_id", F.when(i % 97 != 0, F.col("user_id")).alias("user_id"), F.when(i % 89 != 0, F.col("ts")).alias("ts"),
                     (F.col("event_type") == "click").alias("ok")))


def attempts_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Login attempts: ``error`` events fail, ``click`` events succeed; some
    have no user (id % 97) or no time (id % 89)."""
    return _attempts(table(spark, sf_dir, "events"))


def tokens_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    return e.select(
        i.alias("id"),
        F.col("user_id").cast("string").alias("email"),
        i.cast("string").alias("otp_code"),
        F.when(i % 2 == 0, F.lit("register")).otherwise(F.lit("reset_password")).alias("purpose"),
        (F.col("ts") + F.expr("INTERVAL 2 DAYS")).alias("expires_at"),
        (i % 3 == 0).alias("used"),
        F.col("ts").alias("created_at"),
    )


def changes_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change rows for ``apply_changes``: updates (key % 97), deletes
    (key % 101), a second update of some ids (key % 194), inserts of new ids
    above the current maximum (key % 997), a delete of an unknown id, inserts
    of deleted ids (key % 303) and updates of inserted ones (key % 1994).
    Numbers are missing, of digits and others, mixed."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority", "o_orderstatus")
    max_key = o.agg(F.max("o_orderkey")).scalar()  # scalar subquery, one value
    k = F.col("o_orderkey")
    fields = {
        "case_no": F.concat(F.lit("U-"), k.cast("string")),
        "case_date": F.to_date("o_orderdate"),
        "issues": F.col("o_orderpriority"),
        "description": F.lit("changed"),
        "step_to_resolve": F.lit(None).cast("string"),
        "opened_by": F.lit("ops"),
        "department": F.lit(None).cast("string"),
        "status": F.when(F.col("o_orderstatus") == "F", F.lit(None).cast("string")).otherwise(F.lit("Completed")),
        "resolved_by": F.lit("a1"),
        "remark": F.lit(None).cast("string"),
    }

    def rows(cond, op, seq, id_expr, overrides=None):
        vals = dict(fields, **(overrides or {}))
        return (o.filter(cond)
                 .select(id_expr.alias("id"), *[v.alias(n) for n, v in vals.items()],
                         F.lit(op).alias("op"), F.lit(seq).cast("long").alias("seq")))

    upd = rows(k % 97 == 0, "U", 1, k)
    upd2 = rows(k % 194 == 0, "U", 3, k, {"case_no": F.when(k % 970 == 0, (k + max_key).cast("string")).otherwise(fields["case_no"]), "remark": F.lit("second"), "description": F.lit("changed twice")})
    dele = rows(k % 101 == 0, "D", 2, k)
    ins = rows(k % 997 == 0, "I", 4, k + max_key + 1, {"case_no": F.when(k % 4 == 0, (k * 7 % max_key + max_key).cast("string"))})
    unknown = rows(k % 991 == 0, "D", 5, k + max_key + 100_000)
    # inserted again after the delete, and changed after the insert
    again = rows(k % 303 == 0, "I", 6, k, {"case_no": F.when(k % 2 == 0, F.concat(F.lit("R-"), k.cast("string"))), "description": F.lit("again")})
    over = rows(k % 1994 == 0, "U", 7, k + max_key + 1, {"description": F.lit("after insert")})
    out = upd
    for part in (upd2, dele, ins, unknown, again, over):
        out = out.unionByName(part)
    return out


def incoming_users_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of user creations: some eids exist already (custkey % 3),
    others repeat inside the batch (custkey % 1000), some roles are invalid."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    mx = c.agg(F.max("c_custkey")).scalar()
    return c.select(
        (k + mx).alias("id"),
        F.when(k % 3 == 0, F.col("c_name")).otherwise(F.concat(F.lit("N-"), (k % 1000).cast("string"))).alias("eid"),
        F.when(k % 2 == 0, F.lit("")).otherwise(F.concat(F.lit(" new"), k.cast("string"), F.lit("@example.com ")))
         .alias("email"),
        F.lit(" Ann ").alias("first_name"),
        F.concat(F.lit("Lee"), k.cast("string")).alias("last_name"),
        F.when(k % 2 == 0, F.lit("")).otherwise(F.concat(F.lit(" Agent X"), k.cast("string"), F.lit(" ")))
         .alias("full_name"),
        F.when(k % 10 == 0, F.lit("root")).when(k % 10 == 1, F.lit("admin")).otherwise(F.lit(None).cast("string"))
         .alias("role"),
        (k % 5).alias("region_key"),
        F.when(k % 4 == 0, F.lit("")).otherwise(F.concat(F.lit("Desk "), (k % 9).cast("string"))).alias("position"),
        F.concat(F.lit(" 555-"), k.cast("string"), F.lit(" ")).alias("phone"),
    )


def incoming_sites_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of site creations from nations (some codes too long, some
    short names blank) plus the existing region codes again."""
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    nat = n.select(F.concat(F.lit(" "), F.upper("n_name"), F.lit(" ")).alias("code"), F.col("n_name").alias("name"),
                   F.when(F.col("n_nationkey") % 7 == 0, F.lit(" ")).otherwise(F.substring("n_name", 1, 3))
                    .alias("short_name"),
                   F.col("n_nationkey").cast("long").alias("seq"))
    reg = r.select(F.col("r_name").alias("code"), F.col("r_name").alias("name"), F.lit("R").alias("short_name"),
                   (F.col("r_regionkey") + 100).cast("long").alias("seq"))
    return nat.unionByName(reg)


def grant_requests_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grant/role replacement requests in the order of seq: customers with
    custkey % 10 = 0 ask for their home site, as 'admin' or (% 30) with an
    invalid role; some ask again for two sites without a role (% 20), and once
    more with an invalid one (% 40)."""
    k = F.col("c_custkey")
    req = customer_sites(spark, sf_dir).filter(k % 10 == 0).select(k.alias("user_id"), "location")

    def asked(cond, codes, role, seq):
        return req.filter(cond).select("user_id", codes.alias("codes"), role.alias("role"), F.lit(seq).cast("long").alias("seq"))

    u = F.col("user_id")
    first = asked(u % 10 == 0, F.array("location"), F.when(u % 30 == 0, F.lit("boss")).otherwise(F.lit("admin")), 1)
    second = asked(u % 20 == 0, F.array(F.lit("asia"), F.lit("europe")), F.lit(None).cast("string"), 2)
    return first.unionByName(second).unionByName(asked(u % 40 == 0, F.array(F.lit("africa")), F.lit("boss"), 3))


def changes_with_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``changes_view`` with the site of each case: its own where it exists,
    region ``key % 5`` else.  Some updates (key % 485) name another site,
    where no such case exists."""
    ch = changes_view(spark, sf_dir)
    own = cases_view(spark, sf_dir).select("id", F.col("location").alias("_own"))
    ch = ch.join(own, "id", "left")
    region = table(spark, sf_dir, "region").select("r_regionkey", F.lower("r_name").alias("location"))
    ch = ch.join(region, (F.col("id") % 5) == F.col("r_regionkey"), "left")
    other = (F.col("op") == "U") & (F.col("id") % 485 == 0)
    site = F.when(other, F.col("location")).otherwise(F.coalesce("_own", "location"))
    return ch.withColumn("location", site).drop("r_regionkey", "_own")


def attempts_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``attempts_view`` as a stream over the events file (a file stream
    source takes a folder or a glob, so the file is named by a glob)."""
    schema = table(spark, sf_dir, "events").schema
    return _attempts(spark.readStream.schema(schema).parquet(f"{sf_dir}/events[.]parquet"))
