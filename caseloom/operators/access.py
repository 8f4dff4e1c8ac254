"""Row-level access through site grants.

A superadmin holds every permission on every site; everybody else holds
exactly their grants.  ``effective_permissions`` turns both into one table,
and every access check is a semi-join against it, inside the same plan as
the read it guards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from caseloom.functions.dates import ntz
from caseloom.functions.text import display_label

PERMISSIONS = ("can_view", "can_edit", "can_delete")
LISTED_SITES = 10_000  # up to so many sites are named in a filter; beyond, a semi-join


def site_codes(locations: DataFrame) -> Column:
    """The sorted site codes as an array: a scalar subquery over the site
    table, evaluated with the query that uses it."""
    return locations.agg(F.sort_array(F.collect_set("code"))).scalar()


def all_permissions(df: DataFrame) -> DataFrame:
    """Every permission TRUE (the superadmin projection)."""
    return df.select("*", *[F.lit(True).alias(p) for p in PERMISSIONS])


def effective_permissions(users: DataFrame, grants: DataFrame, locations: DataFrame) -> DataFrame:
    """J5 batch form: (user_id, location_code, can_view, can_edit, can_delete)
    for every user.  Superadmins get every site with all rights (each
    superadmin row fans out to the bounded site list, no cartesian product);
    others get their grants on sites that exist."""
    codes = site_codes(locations)
    supers = (users.filter(F.col("role") == "superadmin")
                   .select(F.col("id").alias("user_id"),
                           F.explode(codes).alias("location_code")))
    supers = all_permissions(supers)
    others = users.filter(F.col("role") != "superadmin").select(F.col("id").alias("user_id"))
    site_df = locations.select(F.col("code").alias("location_code"))
    granted = (grants.join(others, "user_id", "left_semi")
                     .join(site_df, "location_code", "left_semi")
                     .select("user_id", "location_code", *PERMISSIONS))
    return supers.unionByName(granted)


def allowed_sites(users: DataFrame, grants: DataFrame, locations: DataFrame, user_id: int,
                  permission: str = "can_view") -> DataFrame:
    """Sites where ``user_id`` holds ``permission`` (at most the site count)."""
    if permission not in PERMISSIONS:
        raise ValueError(f"unknown permission {permission!r}")
    eff = effective_permissions(users.filter(F.col("id") == F.lit(user_id)),
                                grants.filter(F.col("user_id") == F.lit(user_id)), locations)
    return eff.filter(F.col(permission)).select(F.col("location_code").alias("location")).distinct()


def visible_cases(cases: DataFrame, users: DataFrame, grants: DataFrame, locations: DataFrame,
                  user_id: int, permission: str = "can_view") -> DataFrame:
    """Only the case rows of sites where the user holds ``permission``.
    The allowed sites become an ``IN`` filter on the partition column: on the
    stored table the other sites' files are never listed or read, and no join
    or shuffle is planned.  A longer list is a semi-join with equal results."""
    allowed = allowed_sites(users, grants, locations, user_id, permission)
    rows = allowed.limit(LISTED_SITES + 1).collect()
    if len(rows) > LISTED_SITES:
        return cases.join(allowed, "location", "left_semi")
    codes = sorted(r["location"] for r in rows)
    return cases.filter(F.col("location").isin(*codes) if codes else F.lit(False))


def permitted_changes(changes: DataFrame, users: DataFrame, grants: DataFrame, locations: DataFrame,
                      user_id: int) -> DataFrame:
    """J5 on writes: the changes (location, op I/U/D) that ``user_id`` may
    make -- I and U need ``can_edit`` on the site, D needs ``can_delete``.
    The others are refused, so they change nothing."""
    eff = effective_permissions(users.filter(F.col("id") == F.lit(user_id)),
                                grants.filter(F.col("user_id") == F.lit(user_id)), locations)
    ops = F.concat(F.when(F.col("can_edit"), F.array(F.lit("I"), F.lit("U"))).otherwise(F.array().cast("array<string>")),
                   F.when(F.col("can_delete"), F.array(F.lit("D"))).otherwise(F.array().cast("array<string>")))
    allowed = eff.select(F.col("location_code").alias("location"), F.explode(ops).alias("op"))
    return changes.join(allowed, ["location", "op"], "left_semi").select(*changes.columns)


def has_permission(users: DataFrame, grants: DataFrame, locations: DataFrame, user_id: int, site: str,
                   permission: str = "can_view") -> DataFrame:
    """One-row answer of a single permission check (auth check as data)."""
    hit = allowed_sites(users, grants, locations, user_id, permission).filter(F.col("location") == site)
    return hit.agg((F.count(F.lit(1)) > 0).alias("allowed"))


def sites_of_user(grants: DataFrame, locations: DataFrame, user_id: int | None = None) -> DataFrame:
    """A user's grants with the site names (all users when ``user_id`` is
    None)."""
    g = grants if user_id is None else grants.filter(F.col("user_id") == F.lit(user_id))
    loc = locations.select(F.col("code").alias("location_code"), "name", "short_name")
    return g.join(loc, "location_code", "inner").select("user_id", "location_code", *PERMISSIONS, "name",
                                                        "short_name")


def active_users(users: DataFrame, drop_roles=("superadmin",), as_of=None) -> DataFrame:
    """unlocked users, minus the roles hidden from the resolver list.

    By default the ``is_locked`` flag decides, even after ``locked_until``
    has passed (the flag is cleared only by a success or an unlock).  With
    ``as_of``, a lock that expired by then no longer hides the user."""
    if as_of is None:
        out = users.filter(~F.col("is_locked"))
    else:
        ts = ntz(as_of)
        still = F.col("is_locked") & (F.col("locked_until").isNull() | (F.col("locked_until") > ts))
        out = users.filter(~still)
    if drop_roles:
        out = out.filter(~F.col("role").isin(*drop_roles))
    return out


def resolvers_of_site(users: DataFrame, grants: DataFrame, site: str | None = None,
                      drop_roles=("superadmin",), as_of=None) -> DataFrame:
    """J3 + P5: unlocked users granted on a site (every site when ``site`` is
    None), with the display label, ordered by (full_name, eid)."""
    g = grants if site is None else grants.filter(F.col("location_code") == F.lit(site))
    u = active_users(users, drop_roles, as_of)
    name, label = display_label("full_name", "eid")
    joined = u.join(g.select(F.col("user_id").alias("id"), "location_code"), "id", "inner")
    return (joined.select("location_code", "eid", name.alias("full_name"), "role", label.alias("display"),
                          F.col("full_name").alias("_raw_name"))
                  .orderBy("location_code", "_raw_name", "eid").drop("_raw_name"))
