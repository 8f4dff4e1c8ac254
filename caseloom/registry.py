"""Registered queries: each Spark query next to its DuckDB oracle SQL.

Every query derives its input from the driver tables at ``sf_dir`` (whole
tables) through ``sources.driver_tables``; the oracle derives the same input
with ``sources.driver_sql``.  Computed columns carry the same alias on both
sides.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from caseloom.functions.dates import ntz
from caseloom.operators import access, admin, audit, changes as changes_op, export, ingest, listing, numbering, report
from caseloom.operators.filters import CaseFilter, by_key
from caseloom.plans.lineage import staging_path
from caseloom.sources import driver_tables as dtab, sinks, term_index
from caseloom.schema import CASE_FIELDS
from caseloom.sources.cases import case_by_id, read_grants, read_locations, read_site_tables, read_users, scan_cases, sites_by_name
from caseloom.sources.driver_sql import with_views
from caseloom.sources.importer import read_import, select_import_columns
from caseloom.sources.table_changes import apply_changes_to_table, purge_site_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

# Parameters of the registered queries (fixed, documented in FIXTURES.md).
AS_OF = dt.date(1998, 6, 15)
REPORT_FROM, REPORT_TO = "1996-01-01", "1999-12-31"
SEARCH_TERM = "red"
LOOKUP_ID = 4242
PAGE_SIZE = 10
SITE = "asia"


def register(name: str, sql: str | None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dtab.cases_view(spark, sf_dir)


CASES = with_views("cases")
DATE_RANGE_SQL = f"case_date >= DATE '{REPORT_FROM}' AND case_date <= DATE '{REPORT_TO}'"
PRESENT = "{c} IS NOT NULL AND {c} <> ''"
SHARE_SQL = "CAST((2000 * {c} + {t}) // (2 * {t}) AS DOUBLE) / 10"

# ---------------------------------------------------------------- report family


@register("by_issues_ranked", CASES + f"""
SELECT location, name, count, rank,
       CASE WHEN total > 0 THEN {SHARE_SQL.format(c='count', t='total')} ELSE 0.0 END AS share,
       CASE WHEN first > 0 THEN CAST(100 AS DOUBLE) * count / first ELSE 0.0 END AS bar
FROM (SELECT location, name, count,
             row_number() OVER (PARTITION BY location ORDER BY count DESC, name) AS rank,
             sum(count) OVER (PARTITION BY location) AS total,
             max(count) OVER (PARTITION BY location) AS first
      FROM (SELECT location, issues AS name, count(*) AS count FROM cases
            WHERE {DATE_RANGE_SQL} AND {PRESENT.format(c='issues')}
            GROUP BY location, issues) b) r""")
def q_by_issues_ranked(spark, sf_dir):
    df = CaseFilter(from_date=REPORT_FROM, to_date=REPORT_TO).apply(cases(spark, sf_dir))
    bd = report.by_issues(df)
    ranked = report.with_rank(bd, group_by=["location"])
    return report.with_share(ranked, group_by=["location"]).select("location", "name", "count", "rank",
                                                                   "share", "bar")


@register("case_count", CASES + """
SELECT location, count(*) AS total FROM cases WHERE status = 'Completed' GROUP BY location""")
def q_case_count(spark, sf_dir):
    return report.case_count(CaseFilter(status="Completed").apply(cases(spark, sf_dir)))


@register("stats_kpi", CASES + f"""
SELECT location, count(*) AS total,
       count(CASE WHEN status = 'In progress' THEN 1 END) AS in_progress,
       count(CASE WHEN status = 'Completed' THEN 1 END) AS completed,
       count(CASE WHEN case_date >= DATE '{AS_OF.replace(day=1)}' AND case_date < DATE '1998-07-01' THEN 1 END)
         AS this_month
FROM cases GROUP BY location""")
def q_stats_kpi(spark, sf_dir):
    f = CaseFilter(status="Completed").for_stats()  # the KPI panel drops the status filter
    return report.stats_kpi(f.apply(cases(spark, sf_dir)), AS_OF)


@register("report_summary", CASES + f"""
SELECT location, total, completed, in_progress,
       CASE WHEN total > 0 THEN (200 * completed + total) // (2 * total) ELSE 0 END AS completion_rate
FROM (SELECT location, count(*) AS total,
             count(CASE WHEN status = 'Completed' THEN 1 END) AS completed,
             count(CASE WHEN status = 'In progress' THEN 1 END) AS in_progress
      FROM cases WHERE {DATE_RANGE_SQL} GROUP BY location) s""")
def q_report_summary(spark, sf_dir):
    f = CaseFilter(from_date=REPORT_FROM, to_date=REPORT_TO).for_report()
    return report.report_summary(f.apply(cases(spark, sf_dir)))


@register("by_department", CASES + f"""
SELECT location, department AS name, count(*) AS count FROM cases
WHERE {PRESENT.format(c='department')} GROUP BY location, department""")
def q_by_department(spark, sf_dir):
    return report.by_department(cases(spark, sf_dir))


RESOLVER_TOKENS_SQL = """
  SELECT location, trim(t) AS name FROM cases, unnest(string_split(resolved_by, ',')) AS u(t)
  WHERE resolved_by IS NOT NULL AND resolved_by <> ''
    AND trim(t) NOT IN ('--- Please Select ---', '---', 'Please Select', '')"""


@register("by_resolver", CASES + f"""
SELECT location, name, count(*) AS count FROM ({RESOLVER_TOKENS_SQL}) t GROUP BY location, name""")
def q_by_resolver(spark, sf_dir):
    return report.by_resolver(cases(spark, sf_dir))


@register("by_date", CASES + f"""
SELECT location, CAST(case_date AS DATE) AS date, count(*) AS count FROM cases
WHERE case_date IS NOT NULL AND {DATE_RANGE_SQL} GROUP BY location, CAST(case_date AS DATE)""")
def q_by_date(spark, sf_dir):
    f = CaseFilter(from_date=REPORT_FROM, to_date=REPORT_TO)
    return report.by_date(f.apply(cases(spark, sf_dir)))


@register("by_month", CASES + """
SELECT location, CAST(date_trunc('month', case_date) AS DATE) AS month, count(*) AS count FROM cases
WHERE case_date IS NOT NULL GROUP BY location, CAST(date_trunc('month', case_date) AS DATE)""")
def q_by_month(spark, sf_dir):
    return report.by_month(cases(spark, sf_dir))


REPORT_PAIRS_SQL = f"""
  SELECT location, 'issues' AS dimension, issues AS name FROM cases WHERE {PRESENT.format(c='issues')}
  UNION ALL SELECT location, 'department', department FROM cases WHERE {PRESENT.format(c='department')}
  UNION ALL SELECT location, 'date', CAST(case_date AS VARCHAR) FROM cases WHERE case_date IS NOT NULL
  UNION ALL SELECT location, 'resolver', name FROM ({RESOLVER_TOKENS_SQL}) r"""


DISPLAY_ORDER_SQL = "CASE WHEN dimension = 'date' THEN 0 ELSE -count END, name"


@register("report_all", CASES + f"""
SELECT location, dimension, name, count,
       row_number() OVER (PARTITION BY location, dimension ORDER BY {DISPLAY_ORDER_SQL}) AS rank,
       {SHARE_SQL.format(c='count', t='sum(count) OVER (PARTITION BY location, dimension)')} AS share,
       CAST(100 AS DOUBLE) * count / first_value(count) OVER (PARTITION BY location, dimension ORDER BY {DISPLAY_ORDER_SQL})
         AS bar
FROM (SELECT location, dimension, name, count(*) AS count FROM ({REPORT_PAIRS_SQL}) p
      GROUP BY location, dimension, name) b""")
def q_report_all(spark, sf_dir):
    bd = report.report_all(cases(spark, sf_dir))
    return report.with_share(report.with_rank(bd))


@register("top5_all", CASES + f"""
SELECT * FROM (
  SELECT location, dimension, name, count,
         row_number() OVER (PARTITION BY location, dimension ORDER BY count DESC, name) AS rank
  FROM (SELECT location, dimension, name, count(*) AS count FROM ({REPORT_PAIRS_SQL}) p
        WHERE dimension IN ('issues', 'department', 'resolver')
        GROUP BY location, dimension, name) b) r
WHERE rank <= 5""")
def q_top5_all(spark, sf_dir):
    return report.top_n(report.report_all(cases(spark, sf_dir)))


@register("facet_departments", CASES + f"""
SELECT DISTINCT location, department AS value FROM cases WHERE {PRESENT.format(c='department')}""")
def q_facet_departments(spark, sf_dir):
    return report.facet(cases(spark, sf_dir), "department")


@register("facet_issues", CASES + f"""
SELECT DISTINCT location, issues AS value FROM cases WHERE {PRESENT.format(c='issues')}""")
def q_facet_issues(spark, sf_dir):
    return report.facet(cases(spark, sf_dir), "issues")

# ---------------------------------------------------------------- case list


CASE_COLS = ("id, case_no, case_date, issues, description, step_to_resolve, opened_by, department, status, "
             "resolved_by, remark, created_at, updated_at, location")
TEXT_DATE_COLS = ("id, case_no, CAST(case_date AS VARCHAR) AS case_date, issues, description, step_to_resolve, "
                  "opened_by, department, status, resolved_by, remark, CAST(created_at AS VARCHAR) AS created_at, "
                  "CAST(updated_at AS VARCHAR) AS updated_at, location")


@register("case_list_newest", CASES + f"""
SELECT {TEXT_DATE_COLS} FROM (
  SELECT *, row_number() OVER (PARTITION BY location ORDER BY id DESC) AS rn FROM cases) t
WHERE rn <= {PAGE_SIZE}""")
def q_case_list_newest(spark, sf_dir):
    page = listing.newest(cases(spark, sf_dir), listing.page_limit(str(PAGE_SIZE)), group_by=["location"])
    return listing.with_text_dates(page)


@register("case_list_filtered", CASES + f"""
SELECT {CASE_COLS} FROM cases
WHERE status = 'In progress' AND department = 'BUILDING' AND {DATE_RANGE_SQL}""")
def q_case_list_filtered(spark, sf_dir):
    f = CaseFilter(status="In progress", department="BUILDING", from_date=REPORT_FROM, to_date=REPORT_TO)
    return listing.newest(f.apply(cases(spark, sf_dir)))


@register("case_search", CASES + f"""
SELECT {CASE_COLS} FROM cases
WHERE coalesce(contains(case_no, '{SEARCH_TERM}') OR contains(description, '{SEARCH_TERM}')
      OR contains(opened_by, '{SEARCH_TERM}') OR contains(step_to_resolve, '{SEARCH_TERM}'), false)""")
def q_case_search(spark, sf_dir):
    return listing.newest(CaseFilter(search=SEARCH_TERM).apply(cases(spark, sf_dir)))


@register("case_search_stats", CASES + f"""
SELECT location, count(*) AS total,
       count(CASE WHEN status = 'In progress' THEN 1 END) AS in_progress,
       count(CASE WHEN status = 'Completed' THEN 1 END) AS completed,
       count(CASE WHEN case_date >= DATE '1998-06-01' AND case_date < DATE '1998-07-01' THEN 1 END) AS this_month
FROM cases
WHERE coalesce(contains(case_no, 'gear') OR contains(description, 'gear') OR contains(opened_by, 'gear'), false)
GROUP BY location""")
def q_case_search_stats(spark, sf_dir):
    f = CaseFilter(search="gear").for_stats()
    return report.stats_kpi(f.apply(cases(spark, sf_dir)), AS_OF)


@register("case_search_pattern", CASES + """
SELECT id, case_no, location FROM cases
WHERE coalesce(case_no LIKE '%C-1_1%' OR description LIKE '%C-1_1%' OR opened_by LIKE '%C-1_1%'
      OR step_to_resolve LIKE '%C-1_1%', false)""")
def q_case_search_pattern(spark, sf_dir):
    f = CaseFilter(search="C-1_1", search_pattern=True)
    return f.apply(cases(spark, sf_dir)).select("id", "case_no", "location")


@register("case_by_id", CASES + f"SELECT {CASE_COLS} FROM cases WHERE id = {LOOKUP_ID}")
def q_case_by_id(spark, sf_dir):
    return by_key(cases(spark, sf_dir), "id", LOOKUP_ID)


@register("site_union", CASES + f"SELECT {CASE_COLS} FROM cases")
def q_site_union(spark, sf_dir):
    """Per-site tables (each site's folder of the stored log, read as a
    table of its own, without a site column) united into one fact."""
    path = staging_path(spark, "site-tables")
    sinks.write_case_files(cases(spark, sf_dir), path)
    # sites that hold cases: a table each, so the list is the tables' names
    stored_sites = spark.read.parquet(path).select("location").distinct().collect()
    per_site = {r.location: f"{path}/location={r.location}" for r in stored_sites}
    return read_site_tables(spark, per_site)


# ---------------------------------------------------------------- access

ACCESS = with_views("cases", "users", "grants", "locations", extra={
    "eff": """SELECT u.id AS user_id, l.code AS location_code, TRUE AS can_view, TRUE AS can_edit,
                     TRUE AS can_delete
              FROM users u CROSS JOIN locations l WHERE u.role = 'superadmin'
              UNION ALL
              SELECT g.user_id, g.location_code, g.can_view, g.can_edit, g.can_delete
              FROM grants g JOIN users u ON g.user_id = u.id AND u.role <> 'superadmin'
              WHERE g.location_code IN (SELECT code FROM locations)""",
})
VIEWER, ADMIN_USER = 8, 20


def _dims(spark, sf_dir):
    return dtab.users_view(spark, sf_dir), dtab.grants_view(spark, sf_dir), dtab.locations_view(spark, sf_dir)


@register("visible_cases", ACCESS + f"""
SELECT id, case_no, location FROM cases
WHERE location IN (SELECT location_code FROM eff WHERE user_id = {VIEWER} AND can_edit)""")
def q_visible_cases(spark, sf_dir):
    users, grants, locs = _dims(spark, sf_dir)
    return access.visible_cases(cases(spark, sf_dir), users, grants, locs, VIEWER, "can_edit").select(
        "id", "case_no", "location")


@register("visible_cases_superadmin", ACCESS + f"""
SELECT location, count(*) AS cases FROM cases
WHERE location IN (SELECT location_code FROM eff WHERE user_id = {ADMIN_USER} AND can_delete)
GROUP BY location""")
def q_visible_cases_superadmin(spark, sf_dir):
    users, grants, locs = _dims(spark, sf_dir)
    vis = access.visible_cases(cases(spark, sf_dir), users, grants, locs, ADMIN_USER, "can_delete")
    return vis.groupBy("location").agg(F.count(F.lit(1)).alias("cases"))


@register("effective_permissions", ACCESS + "SELECT * FROM eff")
def q_effective_permissions(spark, sf_dir):
    return access.effective_permissions(*_dims(spark, sf_dir))


@register("sites_of_user", with_views("grants", "locations") + """
SELECT g.user_id, g.location_code, g.can_view, g.can_edit, g.can_delete, l.name, l.short_name
FROM grants g JOIN locations l ON g.location_code = l.code""")
def q_sites_of_user(spark, sf_dir):
    _, grants, locs = _dims(spark, sf_dir)
    return access.sites_of_user(grants, locs)


@register("sites_list", with_views("locations") + "SELECT code, name, short_name FROM locations")
def q_sites_list(spark, sf_dir):
    return sites_by_name(dtab.locations_view(spark, sf_dir))


@register("resolvers_of_site", with_views("users", "grants") + """
SELECT g.location_code, u.eid, coalesce(nullif(u.full_name, ''), u.eid) AS full_name, u.role,
       coalesce(nullif(u.full_name, ''), u.eid) || ' (' || u.eid || ')' AS display
FROM users u JOIN grants g ON u.id = g.user_id
WHERE NOT u.is_locked AND u.role <> 'superadmin'""")
def q_resolvers_of_site(spark, sf_dir):
    users, grants, _ = _dims(spark, sf_dir)
    return access.resolvers_of_site(users, grants)


# ---------------------------------------------------------------- admin

USER_COLS = "id, eid, email, full_name, role, is_locked, locked_until, failed_attempts"


@register("users_with_sites", with_views("users", "grants") + f"""
SELECT {', '.join('u.' + c for c in USER_COLS.split(', '))},
       coalesce(array_to_string(list_sort(list(g.location_code) FILTER (WHERE g.location_code IS NOT NULL)), ','),
                '') AS locations
FROM users u LEFT JOIN grants g ON u.id = g.user_id
GROUP BY {', '.join('u.' + c for c in USER_COLS.split(', '))}""")
def q_users_with_sites(spark, sf_dir):
    users, grants, _ = _dims(spark, sf_dir)
    out = admin.users_with_sites(users, grants)
    return out.withColumn("locations", F.array_join("locations", ","))


@register("site_user_counts", with_views("users", "grants", "locations") + """
SELECT l.code, l.name, l.short_name, count(u.id) AS user_count
FROM locations l LEFT JOIN grants g ON l.code = g.location_code
LEFT JOIN users u ON g.user_id = u.id AND u.role <> 'superadmin'
GROUP BY l.code, l.name, l.short_name""")
def q_site_user_counts(spark, sf_dir):
    users, grants, locs = _dims(spark, sf_dir)
    return admin.site_user_counts(locs, grants, users)


@register("new_users", with_views("users", "incoming_users", extra={
    "shaped": """SELECT id, trim(eid) AS eid, nullif(trim(email), '') AS email,
                        nullif(trim(first_name), '') AS first_name, nullif(trim(last_name), '') AS last_name,
                        coalesce(nullif(trim(full_name), ''),
                                 nullif(trim(concat_ws(' ', trim(coalesce(first_name, '')),
                                                       trim(coalesce(last_name, '')))), '')) AS full_name,
                        coalesce(role, 'user') AS role, nullif(position, '') AS position,
                        nullif(trim(phone), '') AS phone
                 FROM incoming_users""",
}) + """
SELECT id, eid, email, first_name, last_name, full_name, position, phone, role, FALSE AS is_locked,
       CAST(NULL AS TIMESTAMP) AS locked_until, CAST(0 AS BIGINT) AS failed_attempts
FROM (SELECT *, row_number() OVER (PARTITION BY eid ORDER BY id) AS rn FROM shaped
      WHERE eid IS NOT NULL AND eid <> '' AND role IN ('user', 'admin')) s
WHERE rn = 1 AND eid NOT IN (SELECT eid FROM users)""")
def q_new_users(spark, sf_dir):
    return admin.create_users(dtab.incoming_users_view(spark, sf_dir), dtab.users_view(spark, sf_dir))


@register("new_sites", with_views("locations", "incoming_sites") + """
SELECT code, name, short_name FROM (
  SELECT lower(trim(code)) AS code, trim(name) AS name, trim(short_name) AS short_name,
         row_number() OVER (PARTITION BY lower(trim(code)) ORDER BY seq) AS rn
  FROM incoming_sites
  WHERE length(lower(trim(code))) BETWEEN 3 AND 10 AND trim(name) <> '' AND trim(short_name) <> '') s
WHERE rn = 1 AND code NOT IN (SELECT code FROM locations)""")
def q_new_sites(spark, sf_dir):
    return admin.create_sites(dtab.incoming_sites_view(spark, sf_dir), dtab.locations_view(spark, sf_dir))


LAST_REQUEST = {"last_request": """SELECT user_id, code, coalesce(role, 'user') AS role FROM grant_requests
    WHERE coalesce(role, 'user') IN ('user', 'admin')
    QUALIFY seq = max(seq) OVER (PARTITION BY user_id)"""}


@register("grants_replaced", with_views("grants", "grant_requests", extra=LAST_REQUEST) + """
SELECT user_id, location_code, can_view, can_edit, can_delete FROM grants
WHERE user_id NOT IN (SELECT user_id FROM last_request)
UNION ALL SELECT user_id, code, TRUE, TRUE, TRUE FROM last_request""")
def q_grants_replaced(spark, sf_dir):
    return admin.replace_grants(dtab.grants_view(spark, sf_dir), dtab.grant_requests_view(spark, sf_dir))


@register("cases_of_valid_status", CASES + f"""
SELECT location, count(*) FILTER (WHERE status IN ('In progress', 'Completed')) AS valid,
       count(*) FILTER (WHERE status IS NULL OR status NOT IN ('In progress', 'Completed')) AS invalid
FROM cases GROUP BY location""")
def q_cases_of_valid_status(spark, sf_dir):
    ok = admin.valid_status()
    return cases(spark, sf_dir).groupBy("location").agg(F.count(F.when(ok, 1)).alias("valid"), F.count(F.when(~ok, 1)).alias("invalid"))


@register("users_roles_updated", with_views("users", "grant_requests", extra=LAST_REQUEST) + """
SELECT u.id, u.eid, u.email, u.full_name,
       CASE WHEN r.role IS NOT NULL AND u.role <> 'superadmin' THEN r.role ELSE u.role END AS role,
       u.is_locked, u.locked_until, u.failed_attempts
FROM users u LEFT JOIN (SELECT DISTINCT user_id, role FROM last_request) r ON u.id = r.user_id""")
def q_users_roles_updated(spark, sf_dir):
    return admin.update_roles(dtab.users_view(spark, sf_dir), dtab.grant_requests_view(spark, sf_dir))


@register("users_unlocked", with_views("users") + f"""
SELECT id, eid, email, full_name, role,
       CASE WHEN hit THEN FALSE ELSE is_locked END AS is_locked,
       CASE WHEN hit THEN NULL ELSE locked_until END AS locked_until,
       CASE WHEN hit THEN 0 ELSE failed_attempts END AS failed_attempts
FROM (SELECT *, is_locked AND role = 'user' AS hit FROM users) u""")
def q_users_unlocked(spark, sf_dir):
    users = dtab.users_view(spark, sf_dir)
    ids = users.filter(F.col("is_locked") & (F.col("role") == "user")).select("id")
    return admin.unlock(users, ids)


DELETE_USERS_SQL = "SELECT id FROM users WHERE id % 10 = 0 AND role <> 'superadmin'"


@register("users_deleted_cascade", with_views("users", "grants") + f"""
SELECT * FROM grants WHERE user_id NOT IN ({DELETE_USERS_SQL})""")
def q_users_deleted_cascade(spark, sf_dir):
    users, grants, _ = _dims(spark, sf_dir)
    _, kept_grants = admin.delete_users(users, grants, users.filter(F.col("id") % 10 == 0).select("id"))
    return kept_grants


@register("users_after_delete", with_views("users") + f"""
SELECT * FROM users WHERE id NOT IN ({DELETE_USERS_SQL})""")
def q_users_after_delete(spark, sf_dir):
    users, grants, _ = _dims(spark, sf_dir)
    kept_users, _ = admin.delete_users(users, grants, users.filter(F.col("id") % 10 == 0).select("id"))
    return kept_users


@register("sites_deleted_cascade", with_views("grants") + """
SELECT * FROM grants WHERE location_code <> 'europe'""")
def q_sites_deleted_cascade(spark, sf_dir):
    _, grants, locs = _dims(spark, sf_dir)
    _, kept = admin.delete_sites(locs, grants, locs.filter(F.col("code") == "europe").select("code"))
    return kept

# ---------------------------------------------------------------- import


IMPORT_MAP_SQL = """SELECT "No." AS case_no, "Date" AS case_date, "Issues" AS issues, "Description" AS description,
        "Step to Resolve" AS step_to_resolve, "Opened by" AS opened_by, "Department" AS department,
        {status} AS status, "Resolved by" AS resolved_by, "Remark" AS remark, _row FROM import_raw"""
REASON_SQL = """CASE WHEN case_no IS NULL THEN 'null_case_no'
        WHEN case_no = '' OR coalesce(try_cast(case_no AS DOUBLE) = 0, false) THEN 'empty_case_no'
        WHEN NOT (coalesce(trim(issues) <> '', false) OR coalesce(trim(description) <> '', false)
                  OR coalesce(trim(opened_by) <> '', false) OR coalesce(trim(department) <> '', false)
                  OR coalesce(trim(case_date) <> '', false)) THEN 'no_data' END"""
PARSE_SQL = """CAST(coalesce(try_strptime(case_date, '%Y-%m-%d'), try_strptime(case_date, '%d-%b-%y'),
        try_strptime(case_date, '%d/%m/%Y'), try_strptime(case_date, '%m/%d/%Y'),
        try_strptime(case_date, '%d-%m-%Y')) AS DATE)"""


def _import_sql(status: str) -> str:
    return with_views("import_raw", extra={
        "mapped": IMPORT_MAP_SQL.format(status=status),
        "marked": f"SELECT *, {REASON_SQL} AS reject_reason FROM mapped",
        "cleaned": f"""SELECT regexp_replace(case_no, '^(-?[0-9]+)\\.[0-9]+$', '\\1') AS case_no,
                              {PARSE_SQL} AS case_date, issues, description, step_to_resolve, opened_by,
                              department, status, resolved_by, remark, reject_reason, _row FROM marked""",
    })


def _cleaned(spark, sf_dir, with_status=True):
    raw = dtab.import_raw_view(spark, sf_dir, with_status=with_status)
    return ingest.clean_case_rows(select_import_columns(raw))


@register("import_clean", _import_sql('"Status"') + "SELECT * EXCLUDE (reject_reason) FROM cleaned "
                                                    "WHERE reject_reason IS NULL")
def q_import_clean(spark, sf_dir):
    return ingest.accepted(_cleaned(spark, sf_dir))


@register("import_clean_no_status", _import_sql("'In progress'") + "SELECT * EXCLUDE (reject_reason) FROM cleaned "
                                                                   "WHERE reject_reason IS NULL")
def q_import_clean_no_status(spark, sf_dir):
    return ingest.accepted(_cleaned(spark, sf_dir, with_status=False))


@register("import_counts", _import_sql('"Status"') + """
SELECT count(CASE WHEN reject_reason IS NULL THEN 1 END) AS inserted,
       count(CASE WHEN reject_reason IN ('empty_case_no', 'no_data') THEN 1 END) AS skipped FROM cleaned""")
def q_import_counts(spark, sf_dir):
    return ingest.import_counts(_cleaned(spark, sf_dir))


@register("import_reasons", _import_sql('"Status"') + """
SELECT coalesce(reject_reason, 'accepted') AS outcome, count(*) AS rows FROM cleaned
GROUP BY coalesce(reject_reason, 'accepted')""")
def q_import_reasons(spark, sf_dir):
    return ingest.import_reasons(_cleaned(spark, sf_dir))


# ---------------------------------------------------------------- export

SHEET_SQL = CASES.rstrip() + """,
sheet AS (SELECT location, row_number() OVER (PARTITION BY location ORDER BY id) AS "No.",
       coalesce(strftime(case_date, '%-d-%b-%y'), '') AS "Date", issues AS "Issues", description AS "Description",
       step_to_resolve AS "Step to Resolve", opened_by AS "Opened by", department AS "Department",
       status AS "Status", resolved_by AS "Resolved by", remark AS "Remark"
  FROM cases WHERE status = 'Completed')
"""


def _sheet(spark, sf_dir):
    return export.export_rows(CaseFilter(status="Completed").apply(cases(spark, sf_dir)))


@register("export_rows", SHEET_SQL + "SELECT * FROM sheet")
def q_export_rows(spark, sf_dir):
    return _sheet(spark, sf_dir)


@register("export_widths", SHEET_SQL + "\nUNION ALL\n".join(
    f"""SELECT location, '{h}' AS "column",
       CAST(least(greatest(coalesce(max(length(CAST("{h}" AS VARCHAR))), 0), {len(h)}) + 2, 50) AS INTEGER) AS width
       FROM sheet GROUP BY location""" for h in export.HEADERS))
def q_export_widths(spark, sf_dir):
    return export.sheet_widths(CaseFilter(status="Completed").apply(cases(spark, sf_dir)))


def _dash(c):
    return f"CASE WHEN {c} IS NULL OR {c} = '' THEN '-' ELSE {c} END AS {c}"


def _cut(c):
    return (f"CASE WHEN {c} IS NULL THEN '' WHEN length({c}) > 30 THEN substr({c}, 1, 30) || '...' "
            f"ELSE {c} END AS {c}")


@register("display_rows", CASES + f"""
SELECT id, location, {_dash('case_no')}, coalesce(strftime(case_date, '%-d-%b-%y'), '-') AS case_date,
       {_dash('issues')}, {_cut('description')}, {_cut('step_to_resolve')}, {_dash('opened_by')},
       {_dash('department')}, {_dash('status')},
       CASE WHEN lower(status) = 'in progress' THEN 'progress' WHEN lower(status) = 'completed' THEN 'completed'
            ELSE 'pending' END AS status_class,
       {_dash('resolved_by')}, {_dash('remark')}
FROM cases""")
def q_display_rows(spark, sf_dir):
    return export.display_rows(cases(spark, sf_dir))


# ---------------------------------------------------------------- numbering and changes

CHANGES_AS_OF = dt.datetime(2024, 2, 1)
MAX_NO_SQL = """SELECT location, max(CAST(case_no AS BIGINT)) AS max_no
  FROM cases WHERE regexp_full_match(case_no, '[0-9]+') GROUP BY location"""


@register("max_case_no", CASES + """
SELECT location, coalesce(max(CASE WHEN regexp_full_match(case_no, '[0-9]+') THEN CAST(case_no AS BIGINT) END), 0) AS max_no,
       CAST(coalesce(max(CASE WHEN regexp_full_match(case_no, '[0-9]+') THEN CAST(case_no AS BIGINT) END), 0) AS VARCHAR)
         AS max_no_text
FROM cases GROUP BY location""")
def q_max_case_no(spark, sf_dir):
    return numbering.max_case_no(cases(spark, sf_dir))


def _change_fields(t: str) -> str:
    """The fields of a change row with their defaults."""
    text = ", ".join(f"coalesce({t}.{c}, '') AS {c}" for c in ("issues", "description", "step_to_resolve", "opened_by", "department"))
    return (f"{t}.case_date, {text}, coalesce({t}.status, 'In progress') AS status, "
            f"coalesce({t}.resolved_by, '') AS resolved_by, coalesce({t}.remark, '') AS remark")


def _requests_one_after_another(requests: str) -> dict[str, str]:
    """CTEs that go through requests (location, id, seq, kind, case_no) one by
    one a site: ``numbered`` has each one's number."""
    return {
        "queue": f"""SELECT *, row_number() OVER (PARTITION BY location ORDER BY seq, id, case_no NULLS FIRST) AS turn
            FROM ({requests}) t""",
        "counted(location, turn, top)": """SELECT DISTINCT q.location, CAST(0 AS BIGINT), coalesce(mx.max_no, 0)
            FROM queue q LEFT JOIN mx ON q.location = mx.location
          UNION ALL
          SELECT q.location, q.turn, CASE WHEN coalesce(q.case_no, '') = '' THEN c.top + 1
              WHEN regexp_full_match(q.case_no, '[0-9]+') THEN greatest(c.top, CAST(q.case_no AS BIGINT)) ELSE c.top END
            FROM counted c JOIN queue q ON q.location = c.location AND q.turn = c.turn + 1""",
        "numbered": """SELECT q.location, q.id, q.kind,
              CASE WHEN coalesce(q.case_no, '') = '' THEN CAST(c.top AS VARCHAR) ELSE q.case_no END AS case_no
            FROM queue q JOIN counted c ON c.location = q.location AND c.turn = q.turn""",
    }


_STAMP = f"TIMESTAMP '{CHANGES_AS_OF}'"

APPLY_SQL = with_views("cases", "changes_site", extra={
    "dels": "SELECT location, id, max(seq) AS d FROM changes_site WHERE op = 'D' GROUP BY location, id",
    "tail": """SELECT c.*, dels.d FROM changes_site c LEFT JOIN dels ON c.location = dels.location AND c.id = dels.id
        WHERE dels.d IS NULL OR c.seq >= dels.d""",
    "first_ins": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY location, id ORDER BY seq) AS rn
        FROM tail WHERE op = 'I') t WHERE rn = 1""",
    "last_upd": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY location, id ORDER BY seq DESC) AS rn
        FROM tail WHERE op = 'U') t WHERE rn = 1""",
    "kept": """SELECT * FROM cases c
        WHERE NOT EXISTS (SELECT 1 FROM dels x WHERE x.location = c.location AND x.id = c.id)
          AND NOT EXISTS (SELECT 1 FROM last_upd x WHERE x.location = c.location AND x.id = c.id)""",
    "upd": f"""SELECT l.id, coalesce(l.case_no, '') AS case_no, {_change_fields('l')}, c.created_at, {_STAMP} AS updated_at,
        c.location FROM last_upd l JOIN cases c ON l.id = c.id AND l.location = c.location WHERE l.d IS NULL""",
    "ins0": """SELECT f.* FROM first_ins f LEFT JOIN cases c ON f.id = c.id AND f.location = c.location
        WHERE c.id IS NULL OR f.d IS NOT NULL""",
    "mx": MAX_NO_SQL,
    **_requests_one_after_another("""SELECT location, id, seq, 'ins' AS kind, case_no FROM ins0
        UNION ALL SELECT u.location, u.id, u.seq, 'upd', u.case_no FROM last_upd u JOIN cases c
            ON u.id = c.id AND u.location = c.location WHERE u.d IS NULL AND u.case_no <> ''
        UNION ALL SELECT u.location, u.id, u.seq, 'upd', u.case_no FROM last_upd u JOIN ins0 f
            ON u.id = f.id AND u.location = f.location AND u.seq >= f.seq WHERE u.case_no <> ''"""),
    "ins": f"""SELECT i.id, n.case_no, {_change_fields('i')}, {_STAMP} AS created_at, {_STAMP} AS updated_at, i.location
        FROM (SELECT f.* FROM ins0 f LEFT JOIN last_upd u ON f.id = u.id AND f.location = u.location AND u.seq >= f.seq
              WHERE u.id IS NULL) i JOIN numbered n ON i.location = n.location AND i.id = n.id AND n.kind = 'ins'
        UNION ALL
        SELECT u.id, coalesce(u.case_no, '') AS case_no, {_change_fields('u')}, {_STAMP}, {_STAMP}, u.location
        FROM ins0 f JOIN last_upd u ON f.id = u.id AND f.location = u.location AND u.seq >= f.seq""",
})


@register("cases_after_changes", APPLY_SQL + f"""
SELECT {CASE_COLS} FROM kept UNION ALL SELECT {CASE_COLS} FROM upd UNION ALL SELECT {CASE_COLS} FROM ins""")
def q_cases_after_changes(spark, sf_dir):
    return changes_op.apply_changes(cases(spark, sf_dir), dtab.changes_with_site(spark, sf_dir), CHANGES_AS_OF)


@register("numbered_batch", with_views("cases", "changes_site", extra={
    "mx": MAX_NO_SQL,
    **_requests_one_after_another("SELECT location, id, seq, op AS kind, case_no FROM changes_site WHERE op = 'I'"),
}) + "SELECT id, case_no, location FROM numbered")
def q_numbered_batch(spark, sf_dir):
    batch = dtab.changes_with_site(spark, sf_dir).filter(F.col("op") == "I").select("id", "case_no", "location", "seq")
    return numbering.number_batch(batch, cases(spark, sf_dir)).select("id", "case_no", "location")


@register("purge_site", CASES + "SELECT location, count(*) AS cases FROM cases WHERE location <> 'africa' "
                                "GROUP BY location")
def q_purge_site(spark, sf_dir):
    kept, _ = changes_op.purge_site(cases(spark, sf_dir), "africa")
    return kept.groupBy("location").agg(F.count(F.lit(1)).alias("cases"))


@register("purge_count", CASES + "SELECT count(*) AS purged FROM cases WHERE location = 'africa'")
def q_purge_count(spark, sf_dir):
    _, purged = changes_op.purge_site(cases(spark, sf_dir), "africa")
    return purged

# ---------------------------------------------------------------- audit


TOKEN_AS_OF = dt.datetime(2024, 1, 15, 12, 0)
LOCKOUT_FOLD_SQL = with_views("attempts").replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + """,
a AS (
  SELECT user_id, ts, ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM attempts
  WHERE user_id IS NOT NULL AND ts IS NOT NULL),
fold(user_id, rn, cnt, lu, locks, last_lock, locked_now, ts) AS (
  SELECT DISTINCT user_id, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(NULL AS TIMESTAMP), CAST(0 AS BIGINT),
         CAST(NULL AS TIMESTAMP), FALSE, CAST(NULL AS TIMESTAMP) FROM a
  UNION ALL
  SELECT f.user_id, a.rn,
    CASE WHEN f.lu IS NOT NULL AND a.ts < f.lu THEN f.cnt WHEN a.ok THEN 0 ELSE f.cnt + 1 END,
    CASE WHEN f.lu IS NOT NULL AND a.ts < f.lu THEN f.lu WHEN a.ok THEN NULL
         WHEN f.cnt + 1 >= 3 THEN a.ts + INTERVAL 30 MINUTE ELSE f.lu END,
    f.locks + CASE WHEN (f.lu IS NULL OR a.ts >= f.lu) AND NOT a.ok AND f.cnt + 1 >= 3 THEN 1 ELSE 0 END,
    CASE WHEN (f.lu IS NULL OR a.ts >= f.lu) AND NOT a.ok AND f.cnt + 1 >= 3 THEN a.ts ELSE f.last_lock END,
    (f.lu IS NULL OR a.ts >= f.lu) AND NOT a.ok AND f.cnt + 1 >= 3, a.ts
  FROM fold f JOIN a ON a.user_id = f.user_id AND a.rn = f.rn + 1)
"""
LOCKOUT_AUDIT_SQL = LOCKOUT_FOLD_SQL + """
SELECT f.user_id, f.cnt AS attempts, f.lu AS locked_until, f.locks AS n_locks, f.last_lock
FROM fold f JOIN (SELECT user_id, max(rn) AS rn FROM a GROUP BY user_id) m ON f.user_id = m.user_id AND f.rn = m.rn"""


@register("lockout_audit", LOCKOUT_AUDIT_SQL)
def q_lockout_audit(spark, sf_dir):
    return audit.lockout_audit(dtab.attempts_view(spark, sf_dir))


@register("lockout_audit_long", LOCKOUT_AUDIT_SQL)
def q_lockout_audit_long(spark, sf_dir):
    """R1 with every user of more than 8 attempts taken as a long one, whose
    locks are found in log rounds."""
    return audit.lockout_audit(dtab.attempts_view(spark, sf_dir), chunk_size=8)


@register("lockout_unplaced", with_views("attempts") + """
SELECT count(*) FILTER (WHERE user_id IS NULL) AS no_user, count(*) FILTER (WHERE user_id IS NOT NULL AND ts IS NULL) AS no_time
FROM attempts""")
def q_lockout_unplaced(spark, sf_dir):
    return audit.unplaced_attempts(dtab.attempts_view(spark, sf_dir))


@register("latest_valid", with_views("tokens") + f"""
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY email, purpose ORDER BY created_at DESC, id DESC) AS rn FROM tokens
  WHERE NOT used AND expires_at > TIMESTAMP '{TOKEN_AS_OF}' AND created_at <= TIMESTAMP '{TOKEN_AS_OF}') t
WHERE rn = 1""")
def q_latest_valid(spark, sf_dir):
    return audit.latest_valid(dtab.tokens_view(spark, sf_dir), TOKEN_AS_OF, supersede=False)


@register("latest_valid_superseded", with_views("tokens") + f"""
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY email ORDER BY created_at DESC, id DESC) AS rn FROM tokens
  WHERE created_at <= TIMESTAMP '{TOKEN_AS_OF}') t
WHERE rn = 1 AND NOT used AND expires_at > TIMESTAMP '{TOKEN_AS_OF}'""")
def q_latest_valid_superseded(spark, sf_dir):
    return audit.latest_valid(dtab.tokens_view(spark, sf_dir), TOKEN_AS_OF, supersede=True)

# ---------------------------------------------------------------- sources, sinks, options


@register("stored_site_scan", CASES + """
SELECT status, count(*) AS cases FROM cases
WHERE location = 'asia' AND case_date >= DATE '1997-01-01' GROUP BY status""")
def q_stored_site_scan(spark, sf_dir):
    """S5 + S1: write the case log partitioned by site, read one site back
    (partition filter) with a pushed date filter."""
    path = staging_path(spark, "cases")
    sinks.append_cases(cases(spark, sf_dir), path)
    df = CaseFilter(site=SITE, from_date="1997-01-01").apply(scan_cases(spark, path))
    return df.groupBy("status").agg(F.count(F.lit(1)).alias("cases"))


@register("export_roundtrip", CASES + """
SELECT location, CAST(row_number() OVER (PARTITION BY location ORDER BY id) AS VARCHAR) AS case_no, case_date,
       nullif(issues, '') AS issues, nullif(description, '') AS description,
       nullif(step_to_resolve, '') AS step_to_resolve, nullif(opened_by, '') AS opened_by,
       nullif(department, '') AS department, nullif(status, '') AS status, nullif(resolved_by, '') AS resolved_by,
       nullif(remark, '') AS remark
FROM cases WHERE status = 'Completed'""")
def q_export_roundtrip(spark, sf_dir):
    """S4 -> S3 -> X2: export the sheet as CSV (one folder per site), import
    it back; every row is accepted and every cell is as it was (a CSV cell
    cannot tell NULL from the empty text)."""
    path = staging_path(spark, "export")
    sinks.export_cases(_sheet(spark, sf_dir), path)
    back = ingest.accepted(ingest.clean_case_rows(read_import(spark, path)))
    cells = [F.nullif(F.col(c), F.lit("")).alias(c) for c in CASE_FIELDS if c not in ("case_no", "case_date")]
    return back.select("location", "case_no", "case_date", *cells)


@register("imported_table", _import_sql('"Status"') + """
SELECT row_number() OVER (ORDER BY _row) AS id, case_no, case_date, issues, description, step_to_resolve, opened_by,
       department, status, resolved_by, remark, 'asia' AS location FROM cleaned WHERE reject_reason IS NULL""")
def q_imported_table(spark, sf_dir):
    """X2 -> S5: clean the sheet, append its accepted rows to a new case
    table in sheet order, read the table back."""
    path = staging_path(spark, "imported")
    ingest.import_into(select_import_columns(dtab.import_raw_view(spark, sf_dir)), SITE, path, as_of=CHANGES_AS_OF)
    return scan_cases(spark, path).select("id", *CASE_FIELDS, "location")


@register("snapshot_counts", with_views("users", "grants", "locations", "cases") + """
SELECT 'cases' AS "table", count(*) AS rows FROM cases
UNION ALL SELECT 'grants', count(*) FROM grants
UNION ALL SELECT 'locations', count(*) FROM locations
UNION ALL SELECT 'users', count(*) FROM users""")
def q_snapshot_counts(spark, sf_dir):
    """Full snapshot of every table, read back and counted."""
    users, grants, locs = _dims(spark, sf_dir)
    tables = {"cases": cases(spark, sf_dir), "users": users, "grants": grants, "locations": locs}
    paths = sinks.snapshot(tables, staging_path(spark, "snapshot"))
    return sinks.snapshot_counts(spark, paths)


@register("by_department_ci", CASES + """
SELECT location, min(department) AS name, count(*) AS count FROM cases
WHERE department IS NOT NULL AND rtrim(department) <> '' GROUP BY location, lower(rtrim(department))""")
def q_by_department_ci(spark, sf_dir):
    return report.by_department(cases(spark, sf_dir), collation="ci")


@register("permission_check", ACCESS + f"""
SELECT count(*) > 0 AS allowed FROM eff WHERE user_id = {VIEWER} AND location_code = '{SITE}' AND can_edit""")
def q_permission_check(spark, sf_dir):
    users, grants, locs = _dims(spark, sf_dir)
    return access.has_permission(users, grants, locs, VIEWER, SITE, "can_edit")


@register("new_user_grants", with_views("users", "incoming_users", extra={
    "shaped": """SELECT id, trim(eid) AS eid, coalesce(role, 'user') AS role, region_key FROM incoming_users""",
    "created": """SELECT id, region_key FROM (
        SELECT *, row_number() OVER (PARTITION BY eid ORDER BY id) AS rn FROM shaped
        WHERE eid IS NOT NULL AND eid <> '' AND role IN ('user', 'admin')) s
      WHERE rn = 1 AND eid NOT IN (SELECT eid FROM users)""",
}) + """
SELECT c.id AS user_id, lower(r.r_name) AS location_code, TRUE AS can_view, TRUE AS can_edit, TRUE AS can_delete
FROM created c JOIN region r ON c.region_key = r.r_regionkey""")
def q_new_user_grants(spark, sf_dir):
    """D8 + S7: the new users' requested sites, every right granted."""
    incoming = dtab.incoming_users_view(spark, sf_dir)
    created = admin.create_users(incoming, dtab.users_view(spark, sf_dir)).select("id")
    region = dtab.table(spark, sf_dir, "region").select("r_regionkey", F.lower("r_name").alias("code"))
    req = (created.join(incoming.select("id", "region_key"), "id")
                  .join(F.broadcast(region), F.col("region_key") == F.col("r_regionkey"))
                  .groupBy("id").agg(F.collect_set("code").alias("codes")))
    return admin.default_grants(req, user_col="id")


@register("by_issues", CASES + f"""
SELECT location, issues AS name, count(*) AS count FROM cases
WHERE {PRESENT.format(c='issues')} GROUP BY location, issues""")
def q_by_issues(spark, sf_dir):
    return report.by_issues(cases(spark, sf_dir))


@register("lockout_events", LOCKOUT_FOLD_SQL + """
SELECT user_id, ts AS locked_at, lu AS locked_until, cnt AS attempts FROM fold WHERE locked_now""")
def q_lockout_events(spark, sf_dir):
    return audit.lockout_events(dtab.attempts_view(spark, sf_dir))


@register("resolvers_as_of", with_views("users", "grants") + """
SELECT g.location_code, u.eid, coalesce(nullif(u.full_name, ''), u.eid) AS full_name, u.role,
       coalesce(nullif(u.full_name, ''), u.eid) || ' (' || u.eid || ')' AS display
FROM users u JOIN grants g ON u.id = g.user_id
WHERE NOT (u.is_locked AND (u.locked_until IS NULL OR u.locked_until > TIMESTAMP '2024-02-01 00:00:00'))
  AND u.role <> 'superadmin'""")
def q_resolvers_as_of(spark, sf_dir):
    users, grants, _ = _dims(spark, sf_dir)
    return access.resolvers_of_site(users, grants, as_of=CHANGES_AS_OF)


@register("stored_changes", APPLY_SQL + f"""
SELECT {CASE_COLS} FROM kept UNION ALL SELECT {CASE_COLS} FROM upd UNION ALL SELECT {CASE_COLS} FROM ins""")
def q_stored_changes(spark, sf_dir):
    """D1-D3 at rest: store the case log, apply the change batch by
    replacing only the touched files, read the new version back."""
    path = staging_path(spark, "changes-cases")
    sinks.append_cases(cases(spark, sf_dir), path)
    apply_changes_to_table(spark, path, dtab.changes_with_site(spark, sf_dir), CHANGES_AS_OF)
    return scan_cases(spark, path)


def _lockout_updates(spark, sf_dir):
    """The attempts stream through the stateful lockout fold (watermark delay
    0: a static file arrives in order), run until the available input is
    consumed."""
    from caseloom.streaming import start_lockout_stream
    out = staging_path(spark, "lockout-stream-out")
    q = start_lockout_stream(dtab.attempts_stream(spark, sf_dir), "parquet", out,
                             name=f"lockout_{uuid.uuid4().hex[:8]}", available_now=True, watermark="0 seconds")
    q.awaitTermination()
    return spark.read.parquet(out)


@register("lockout_stream_audit", LOCKOUT_AUDIT_SQL)
def q_lockout_stream_audit(spark, sf_dir):
    """R1 as Structured Streaming: the last update per user."""
    from caseloom.streaming import lockout_stream_final
    return lockout_stream_final(_lockout_updates(spark, sf_dir)).select("user_id", "attempts", "locked_until", "n_locks",
                                                                        "last_lock")


@register("stored_case_by_id", CASES + f"SELECT {CASE_COLS} FROM cases WHERE id = {LOOKUP_ID}")
def q_stored_case_by_id(spark, sf_dir):
    """F7 at rest: the cases of one id, by bloom filter."""
    path = staging_path(spark, "lookup-cases")
    sinks.append_cases(cases(spark, sf_dir), path)
    return case_by_id(spark, path, None, LOOKUP_ID)


def _indexed_log(spark, sf_dir):
    """The stored case log in two versions; the trigram index covers the
    files of the first."""
    path = staging_path(spark, "search-cases")
    log = cases(spark, sf_dir)
    half = F.col("case_date") < F.lit("1995-06-01").cast("date")
    sinks.append_cases(log.filter(F.coalesce(half, F.lit(True))), path)
    term_index.index_terms(spark, path)
    sinks.append_cases(log.filter(~half), path)
    return path


@register("stored_case_search", CASES + f"""
SELECT {CASE_COLS} FROM cases
WHERE coalesce(contains(lower(case_no), '{SEARCH_TERM}') OR contains(lower(description), '{SEARCH_TERM}')
      OR contains(lower(opened_by), '{SEARCH_TERM}') OR contains(lower(step_to_resolve), '{SEARCH_TERM}'), false)""")
def q_stored_case_search(spark, sf_dir):
    """F3 at rest in either letter case: files of the index without the
    term's trigrams are skipped, files that it does not cover are read."""
    return term_index.search_cases(spark, _indexed_log(spark, sf_dir), CaseFilter(search=SEARCH_TERM.upper(), collation="ci"))


@register("stored_case_search_pattern", CASES + """
SELECT id, case_no, location FROM cases
WHERE case_date >= DATE '1995-01-01' AND coalesce(case_no LIKE '%C-1_1%' OR description LIKE '%C-1_1%' OR opened_by LIKE '%C-1_1%'
      OR step_to_resolve LIKE '%C-1_1%', false)""")
def q_stored_case_search_pattern(spark, sf_dir):
    f = CaseFilter(search="C-1_1", search_pattern=True, from_date="1995-01-01")
    return term_index.search_cases(spark, _indexed_log(spark, sf_dir), f).select("id", "case_no", "location")


@register("lockout_stream_counts", with_views("attempts") + """
SELECT count(*) FILTER (WHERE user_id IS NOT NULL AND ts IS NOT NULL) AS applied, CAST(0 AS BIGINT) AS pending,
       CAST(0 AS BIGINT) AS late, count(*) FILTER (WHERE user_id IS NOT NULL AND ts IS NULL) AS no_time,
       count(*) FILTER (WHERE user_id IS NULL) AS no_user
FROM attempts""")
def q_lockout_stream_counts(spark, sf_dir):
    """R1 on the stream: every attempt that arrived, by what became of it."""
    from caseloom.streaming import lockout_stream_counts
    return lockout_stream_counts(_lockout_updates(spark, sf_dir))


# ---------------------------------------------------------------- stored dimensions, guards, collation, order


@register("users_appended", with_views("users", "incoming_users", extra={
    "created": """SELECT * FROM (
        SELECT id, trim(eid) AS eid, nullif(trim(email), '') AS email, 'Ann' AS first_name, last_name,
               coalesce(nullif(trim(full_name), ''), 'Ann ' || last_name) AS full_name,
               nullif(position, '') AS position, trim(phone) AS phone, coalesce(role, 'user') AS role,
               row_number() OVER (PARTITION BY trim(eid) ORDER BY id) AS rn
        FROM incoming_users WHERE coalesce(role, 'user') IN ('user', 'admin')) s
      WHERE rn = 1 AND eid NOT IN (SELECT eid FROM users)""",
}) + """
SELECT id, eid, email, first_name, last_name, full_name, position, phone, role, FALSE AS is_locked,
       CAST(NULL AS TIMESTAMP) AS locked_until, CAST(0 AS BIGINT) AS failed_attempts FROM created
UNION ALL
SELECT id, eid, email, NULL, NULL, full_name, NULL, NULL, role, is_locked, locked_until, failed_attempts FROM users""")
def q_users_appended(spark, sf_dir):
    """D8 + S8: created users appended to the stored user table, read back."""
    path = staging_path(spark, "users")
    users = dtab.users_view(spark, sf_dir)
    sinks.append_users(users, path)
    sinks.append_users(admin.create_users(dtab.incoming_users_view(spark, sf_dir), read_users(spark, path)), path)
    return read_users(spark, path)


@register("stored_dimensions", with_views("grants", "locations") + """
SELECT g.user_id, g.location_code, g.can_view, g.can_edit, g.can_delete, l.name, l.short_name
FROM grants g JOIN locations l ON g.location_code = l.code""")
def q_stored_dimensions(spark, sf_dir):
    """Grants and sites stored, read with their schemas, joined."""
    _, grants, locs = _dims(spark, sf_dir)
    paths = sinks.snapshot({"grants": grants, "locations": locs}, staging_path(spark, "dimensions"))
    return access.sites_of_user(read_grants(spark, paths["grants"]), read_locations(spark, paths["locations"]))


@register("seed_grants", with_views("users", "locations") + """
SELECT u.id AS user_id, l.code AS location_code, TRUE AS can_view, TRUE AS can_edit, TRUE AS can_delete
FROM users u, locations l WHERE u.role = 'superadmin'""")
def q_seed_grants(spark, sf_dir):
    users, _, locs = _dims(spark, sf_dir)
    return admin.grants_on_all_sites(users.filter(F.col("role") == "superadmin"), locs)


@register("permitted_changes", with_views("changes_site", "users", "grants", "locations", extra={
    "mine": f"""SELECT g.* FROM grants g JOIN users u ON g.user_id = u.id AND u.role <> 'superadmin'
                WHERE g.user_id = {VIEWER} AND g.location_code IN (SELECT code FROM locations)""",
}) + """
SELECT c.id, c.op, c.seq, c.location FROM changes_site c JOIN mine ON c.location = mine.location_code
WHERE (c.op IN ('I', 'U') AND mine.can_edit) OR (c.op = 'D' AND mine.can_delete)""")
def q_permitted_changes(spark, sf_dir):
    """J5 on writes: the change rows that the user may make."""
    users, grants, locs = _dims(spark, sf_dir)
    ch = access.permitted_changes(dtab.changes_with_site(spark, sf_dir), users, grants, locs, VIEWER)
    return ch.select("id", "op", "seq", "location")


@register("case_list_ci", CASES + f"""
SELECT {CASE_COLS} FROM cases WHERE lower(rtrim(status)) = 'in progress' AND lower(rtrim(department)) = 'building'""")
def q_case_list_ci(spark, sf_dir):
    f = CaseFilter(status="IN PROGRESS ", department="Building", collation="ci")
    return listing.newest(f.apply(cases(spark, sf_dir)))


@register("case_search_ci", CASES + f"""
SELECT {CASE_COLS} FROM cases
WHERE coalesce(contains(lower(case_no), '{SEARCH_TERM}') OR contains(lower(description), '{SEARCH_TERM}')
      OR contains(lower(opened_by), '{SEARCH_TERM}') OR contains(lower(step_to_resolve), '{SEARCH_TERM}'), false)""")
def q_case_search_ci(spark, sf_dir):
    return listing.oldest_first(CaseFilter(search=SEARCH_TERM.upper(), collation="ci").apply(cases(spark, sf_dir)))


@register("new_users_ci", with_views("users", "incoming_users") + """
SELECT id, eid FROM (
  SELECT id, lower(eid) AS eid, row_number() OVER (PARTITION BY lower(eid) ORDER BY id) AS rn
  FROM incoming_users WHERE coalesce(role, 'user') IN ('user', 'admin')) s
WHERE rn = 1 AND lower(eid) NOT IN (SELECT lower(eid) FROM users)""")
def q_new_users_ci(spark, sf_dir):
    """J6 under the database's collation: a batch in another letter case
    creates none of the users that exist."""
    batch = dtab.incoming_users_view(spark, sf_dir)
    batch = batch.withColumn("eid", F.lower("eid"))
    return admin.create_users(batch, dtab.users_view(spark, sf_dir), collation="ci").select("id", "eid")


# departments as three ways of writing them: with accents, in small letters with trailing spaces, as they are
ACCENTED = ("AEIOU", "ÀÉÎÖÜ")
SPELLED = f"""CASE WHEN id % 3 = 0 THEN translate(department, '{ACCENTED[0]}', '{ACCENTED[1]}')
    WHEN id % 3 = 1 THEN lower(department) || '  ' ELSE department END"""
SPELLED_CASES = with_views("cases", extra={"spelled": f"SELECT * REPLACE ({SPELLED} AS department) FROM cases"})
FOLDED = "lower(strip_accents(rtrim({c})))"


def _spelled(spark, sf_dir):
    i, d = F.col("id") % 3, F.col("department")
    return cases(spark, sf_dir).withColumn("department", F.when(i == 0, F.translate(d, *ACCENTED)).when(i == 1, F.concat(F.lower(d), F.lit("  "))).otherwise(d))


@register("by_department_ai", SPELLED_CASES + f"""
SELECT location, min(department) AS name, count(*) AS count FROM spelled
WHERE department IS NOT NULL AND rtrim(department) <> '' GROUP BY location, {FOLDED.format(c='department')}""")
def q_by_department_ai(spark, sf_dir):
    """A4 under the database's collation: spellings with accents are one."""
    return report.by_department(_spelled(spark, sf_dir), collation="ai")


@register("departments_ai", SPELLED_CASES + f"""
SELECT location, min(department) AS value FROM spelled
WHERE department IS NOT NULL AND rtrim(department) <> '' GROUP BY location, {FOLDED.format(c='department')}""")
def q_departments_ai(spark, sf_dir):
    return report.facet(_spelled(spark, sf_dir), "department", collation="ai")


@register("case_list_ai", SPELLED_CASES + f"""
SELECT {CASE_COLS} FROM spelled WHERE {FOLDED.format(c='status')} = 'in progress' AND {FOLDED.format(c='department')} = 'building'""")
def q_case_list_ai(spark, sf_dir):
    f = CaseFilter(status="ÍN PROGRESS", department="Büildïng ", collation="ai")
    return listing.newest(f.apply(_spelled(spark, sf_dir)))


@register("case_search_ai", SPELLED_CASES + f"""
SELECT {CASE_COLS} FROM spelled
WHERE coalesce(contains(lower(strip_accents(description)), '{SEARCH_TERM}'), false) OR contains(lower(strip_accents(coalesce(department, ''))), '{SEARCH_TERM}')""")
def q_case_search_ai(spark, sf_dir):
    """F3 over description and department, the term with an accent."""
    f = CaseFilter(search=SEARCH_TERM.replace("e", "É"), search_columns=("description", "department"), collation="ai")
    return listing.oldest_first(f.apply(_spelled(spark, sf_dir)))


@register("new_users_ai", with_views("users", "incoming_users") + """
SELECT id, eid FROM (
  SELECT id, translate(trim(eid), 'aeou', 'àéöü') AS eid, row_number() OVER (PARTITION BY lower(trim(eid)) ORDER BY id) AS rn
  FROM incoming_users WHERE coalesce(role, 'user') IN ('user', 'admin')) s
WHERE rn = 1 AND lower(strip_accents(eid)) NOT IN (SELECT lower(strip_accents(eid)) FROM users)""")
def q_new_users_ai(spark, sf_dir):
    """A batch written with accents creates none of the users that exist."""
    batch = dtab.incoming_users_view(spark, sf_dir).withColumn("eid", F.translate("eid", "aeou", "àéöü"))
    return admin.create_users(batch, dtab.users_view(spark, sf_dir), collation="ai").select("id", "eid")


@register("departments_ordered", CASES + f"""
SELECT location, department AS name, count(*) AS count FROM cases WHERE {PRESENT.format(c='department')}
GROUP BY location, department""")
def q_departments_ordered(spark, sf_dir):
    """A5 + O3: departments by count descending, then name."""
    return report.order_by_count(report.by_department(cases(spark, sf_dir)))


@register("purge_at_rest", CASES + f"SELECT {CASE_COLS} FROM cases WHERE location <> 'africa'")
def q_purge_at_rest(spark, sf_dir):
    """D4 at rest: purge a site of the stored table, read the table back."""
    path = staging_path(spark, "purged")
    sinks.append_cases(cases(spark, sf_dir), path)
    purge_site_table(spark, path, "africa")
    return scan_cases(spark, path)
