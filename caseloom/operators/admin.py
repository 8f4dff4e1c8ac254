"""User, site and grant administration as batch table changes
(J1, J2, J6-J8, D5-D8, S7, F10).  Each function returns the new table (or
the rows to add); nothing is written in place."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from caseloom.functions.text import collation_key, py_strip
from caseloom.operators.access import PERMISSIONS, site_codes
from caseloom.operators.report import collect_sorted
from caseloom.schema import ROLE_ORDER, SITE_CODE_MAX_LEN, SITE_CODE_MIN_LEN, STATUSES, VALID_UPDATE_ROLES


def role_rank(col: str = "role") -> F.Column:
    """ENUM ordinal of a role (user=1, admin=2, superadmin=3; 0 unknown)."""
    return F.array_position(F.array(*[F.lit(r) for r in ROLE_ORDER]), F.col(col))


def valid_role(col: str = "role", allowed=VALID_UPDATE_ROLES) -> F.Column:
    """role membership."""
    return F.col(col).isin(*allowed)


def valid_status(col: str = "status") -> F.Column:
    """status membership (False for NULL)."""
    return F.coalesce(F.col(col).isin(*STATUSES), F.lit(False))


def valid_site_code(col: str = "code") -> F.Column:
    """a site code is 3 to 10 characters after strip + lower."""
    n = F.length(F.col(col))
    return F.col(col).isNotNull() & (n >= SITE_CODE_MIN_LEN) & (n <= SITE_CODE_MAX_LEN)


def users_with_sites(users: DataFrame, grants: DataFrame) -> DataFrame:
    """J1 + A14 + O4: each user with the sorted list of granted site codes
    (empty list without grants), ordered by role ordinal desc, then eid.
    Grants are aggregated per user before the join (at most one row per
    user meets the user table)."""
    per_user = grants.groupBy("user_id").agg(collect_sorted("location_code").alias("locations"))
    out = users.join(per_user, users["id"] == per_user["user_id"], "left").drop("user_id")
    out = out.withColumn("locations", F.coalesce("locations", F.array().cast("array<string>")))
    return (out.select("id", "eid", "email", "full_name", "role", "is_locked", "locked_until", "failed_attempts",
                       "locations")
               .orderBy(F.desc(role_rank("role")), "eid"))


def site_user_counts(locations: DataFrame, grants: DataFrame, users: DataFrame) -> DataFrame:
    """J2 + A15: every site with the number of non-superadmin users granted on
    it (0 kept), ordered by name."""
    non_super = users.filter(F.col("role") != "superadmin").select(F.col("id").alias("user_id"))
    counts = (grants.join(non_super, "user_id", "left_semi")
                    .groupBy("location_code").agg(F.count(F.lit(1)).alias("user_count")))
    out = locations.join(counts, locations["code"] == counts["location_code"], "left")
    return (out.select("code", "name", "short_name", F.coalesce("user_count", F.lit(0)).alias("user_count"))
               .orderBy("name", "code"))


def first_per_key(df: DataFrame, key: str, order_col: str) -> DataFrame:
    """Keep the row with the smallest ``order_col`` per ``key``.  A min over
    a struct aggregates partially before the shuffle, so one hot key does
    not gather its rows in one task."""
    cols = [c for c in df.columns if c != key]
    picked = df.groupBy(key).agg(F.min(F.struct(order_col, *[c for c in cols if c != order_col])).alias("_r"))
    return picked.select(key, *[F.col(f"_r.{c}").alias(c) for c in cols]).select(*df.columns)


def only_new(incoming: DataFrame, existing: DataFrame, key: str, order_col: str, existing_key: str | None = None,
             collation: str | None = None) -> DataFrame:
    """Incoming rows whose key is new -- first occurrence within the
    batch, and absent from the existing table; under ``collation="ci"`` keys
    that differ only in letter case or trailing spaces are one key."""
    keyed = incoming.withColumn("_key", collation_key(key, collation))
    first = first_per_key(keyed, "_key", order_col)
    ex = existing.select(collation_key(existing_key or key, collation).alias("_key")).distinct()
    return first.join(ex, "_key", "left_anti").select(*incoming.columns)


def _blank_to_null(c: F.Column) -> F.Column:
    s = py_strip(c)
    return F.when(s == "", F.lit(None).cast("string")).otherwise(s)


def create_users(incoming: DataFrame, users: DataFrame, collation: str | None = None) -> DataFrame:
    """New user rows with field defaults: strip every text (position is
    taken as given), blank -> NULL, full_name falls back to "first last", role
    defaults to 'user' and must be valid (F10); eid must be present and new
    (J6).  Position and phone may be missing from the batch (NULL)."""
    for c in ("position", "phone"):
        if c not in incoming.columns:
            incoming = incoming.withColumn(c, F.lit(None).cast("string"))
    full = F.coalesce(_blank_to_null(F.col("full_name")),
                      _blank_to_null(F.concat_ws(" ", py_strip(F.coalesce("first_name", F.lit(""))),
                                                 py_strip(F.coalesce("last_name", F.lit(""))))))
    shaped = incoming.select(
        "id",
        py_strip(F.col("eid")).alias("eid"),
        _blank_to_null(F.col("email")).alias("email"),
        _blank_to_null(F.col("first_name")).alias("first_name"),
        _blank_to_null(F.col("last_name")).alias("last_name"),
        full.alias("full_name"),
        F.nullif(F.col("position"), F.lit("")).alias("position"),
        _blank_to_null(F.col("phone")).alias("phone"),
        F.coalesce(F.col("role"), F.lit("user")).alias("role"),
    ).filter(F.col("eid").isNotNull() & (F.col("eid") != "") & valid_role("role"))
    new = only_new(shaped, users, "eid", "id", collation=collation)
    return new.select("*", F.lit(False).alias("is_locked"), F.lit(None).cast("timestamp_ntz").alias("locked_until"),
                      F.lit(0).cast("long").alias("failed_attempts"))


def create_sites(incoming: DataFrame, locations: DataFrame) -> DataFrame:
    """New sites: code = lower(strip(code)) of 3-10 characters, every
    field present, code new (J6, first occurrence in the batch wins)."""
    shaped = incoming.select(
        F.lower(py_strip(F.col("code"))).alias("code"),
        py_strip(F.col("name")).alias("name"),
        py_strip(F.col("short_name")).alias("short_name"),
        F.col("seq"),
    ).filter(valid_site_code("code") & (F.col("name") != "") & (F.col("short_name") != "")
             & F.col("name").isNotNull() & F.col("short_name").isNotNull())
    return only_new(shaped, locations, "code", "seq").select("code", "name", "short_name")


def default_grants(requests: DataFrame, user_col: str = "user_id", codes_col: str = "codes") -> DataFrame:
    """One grant with every right per (user, requested site code)."""
    return (requests.select(F.col(user_col).alias("user_id"), F.explode(codes_col).alias("location_code"))
                    .distinct()
                    .select("user_id", "location_code", *[F.lit(True).alias(p) for p in PERMISSIONS]))


def grants_on_all_sites(users: DataFrame, locations: DataFrame, user_col: str = "id") -> DataFrame:
    """S7 seed form: every site, every right, for each given user (the site
    list is a bounded dimension, exploded per user -- no cartesian join)."""
    codes = site_codes(locations)
    req = users.select(F.col(user_col).alias("user_id"),
                       codes.alias("codes"))
    return default_grants(req)


def requested_role() -> F.Column:
    """The role a request asks for; ``user`` when it names none."""
    return F.coalesce(F.col("role"), F.lit("user"))


def last_requests(requests: DataFrame) -> DataFrame:
    """What the requests (user_id, codes, role, seq) come to, one row a
    user: (user_id, codes, role) of the last one with a valid role, as each
    replaces what the one before it set.  A request with an invalid role is
    refused as a whole; without ``seq`` all stand at one place, where the
    greatest by role and codes counts.  A ``max_by`` aggregate, partial before
    the shuffle, so a user with very many requests is not gathered."""
    role = requested_role() if "role" in requests.columns else F.lit("user")
    seq = F.col("seq") if "seq" in requests.columns else F.lit(0)
    asked = requests.select("user_id", "codes", role.alias("role"), seq.alias("seq")).filter(valid_role("role"))
    last = F.max_by(F.struct("codes", "role"), F.struct("seq", "role", "codes"))
    return asked.groupBy("user_id").agg(last.alias("_last")).select("user_id", "_last.codes", "_last.role")


def replace_grants(grants: DataFrame, requests: DataFrame) -> DataFrame:
    """For each requesting user, drop all their grants and insert the set
    of their last valid request with every right; other users keep theirs."""
    last = last_requests(requests)
    kept = grants.join(last.select("user_id"), "user_id", "left_anti")
    return kept.unionByName(default_grants(last))


def update_roles(users: DataFrame, requests: DataFrame) -> DataFrame:
    """D5 role part: set the role of the last valid request (``user`` when it
    names none) unless the user is a superadmin (J8 guards role changes as
    well)."""
    req = last_requests(requests).select(F.col("user_id").alias("id"), F.col("role").alias("_new"))
    out = users.join(req, "id", "left")
    new_role = F.when(F.col("_new").isNotNull() & (F.col("role") != "superadmin"), F.col("_new")).otherwise(F.col("role"))
    return out.withColumn("role", new_role).drop("_new").select(*users.columns)


def unlock(users: DataFrame, ids: DataFrame) -> DataFrame:
    """Clear is_locked, locked_until and failed_attempts of ``ids``."""
    hit = ids.select(F.col("id")).distinct().withColumn("_hit", F.lit(True))
    out = users.join(hit, "id", "left")
    h = F.coalesce(F.col("_hit"), F.lit(False))
    return (out.withColumn("is_locked", F.when(h, F.lit(False)).otherwise(F.col("is_locked")))
               .withColumn("locked_until", F.when(h, F.lit(None).cast("timestamp_ntz")).otherwise(F.col("locked_until")))
               .withColumn("failed_attempts", F.when(h, F.lit(0).cast("long")).otherwise(F.col("failed_attempts")))
               .drop("_hit").select(*users.columns))


def protect(deleted_ids: DataFrame, users: DataFrame) -> DataFrame:
    """Superadmins are never deleted."""
    supers = users.filter(F.col("role") == "superadmin").select("id")
    return deleted_ids.select("id").distinct().join(supers, "id", "left_anti")


def cascade(child: DataFrame, deleted: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Drop child rows whose parent is deleted (ON DELETE CASCADE)."""
    gone = deleted.select(F.col(parent_key).alias(child_key)).distinct()
    return child.join(gone, child_key, "left_anti")


def delete_users(users: DataFrame, grants: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Remove users (superadmins protected) and cascade to their grants."""
    gone = protect(ids, users)
    return users.join(gone, "id", "left_anti"), cascade(grants, gone, "user_id", "id")


def delete_sites(locations: DataFrame, grants: DataFrame, codes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Remove sites and cascade to their grants."""
    gone = codes.select("code").distinct()
    return locations.join(gone, "code", "left_anti"), cascade(grants, gone, "location_code", "code")

