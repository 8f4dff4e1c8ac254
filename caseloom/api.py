"""Request-level entry points: one function per data request of the case-log
application, composed from the operators.

Each function takes the case table as a DataFrame (e.g.
``sources.cases.scan_cases(spark, path)``) plus an ``Access`` context and
the request parameters, and returns DataFrames -- nothing is collected.
The access check is part of the returned plan (a partition filter on the
sites the user may read), never a separate round trip.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from caseloom.operators import access, admin, audit, changes, export, ingest, listing, numbering, report
from caseloom.operators.filters import CaseFilter
from caseloom.schema import CASE_FIELDS


@dataclass(frozen=True)
class Access:
    """Who asks: the user id and the user, grant and site tables."""

    users: DataFrame
    grants: DataFrame
    locations: DataFrame
    user_id: int

    def cases(self, cases: DataFrame, permission: str = "can_view") -> DataFrame:
        return access.visible_cases(cases, self.users, self.grants, self.locations, self.user_id, permission)

    def changes(self, change_rows: DataFrame) -> DataFrame:
        return access.permitted_changes(change_rows, self.users, self.grants, self.locations, self.user_id)

    def may(self, site: str, permission: str) -> bool:
        return access.has_permission(self.users, self.grants, self.locations, self.user_id, site, permission).first()[0]


def _site_cases(cases: DataFrame, who: Access | None, site: str, permission: str = "can_view") -> DataFrame:
    rows = cases.filter(F.col("location") == F.lit(site))
    return who.cases(rows, permission) if who is not None else rows


# ---------------------------------------------------------------- case list


def list_cases(cases: DataFrame, who: Access | None, site: str, f: CaseFilter = CaseFilter(),
               limit: str | int | None = None) -> tuple[DataFrame, DataFrame]:
    """GET cases: (page newest first with text dates, one-row total).  The
    total ignores the limit; the limit applies only when all digits."""
    rows = f.apply(_site_cases(cases, who, site))
    page = listing.with_text_dates(listing.newest(rows, listing.page_limit(limit)))
    return page, report.case_count(rows, group_by=())


def search_stored(spark, table_path: str, who: Access | None, f: CaseFilter) -> DataFrame:
    """Search over all sites of the stored table (those the user may view with
    ``who``); files without the term are skipped by the table's trigram index,
    where ``sources.term_index.index_terms`` has covered them."""
    from caseloom.sources.term_index import search_cases
    rows = search_cases(spark, table_path, f)
    return who.cases(rows) if who is not None else rows


def case(cases: DataFrame, who: Access | None, site: str, case_id: int) -> DataFrame:
    """GET one case by site and id (no row where there is none, or where the
    user may not view the site)."""
    return _site_cases(cases, who, site).filter(F.col("id") == F.lit(case_id))


def max_no(cases: DataFrame, site: str, who: Access | None = None) -> DataFrame:
    """GET max case number of a site (one row; 0 when none).  With ``who``
    numbers of sites that the user may not view are not told (0)."""
    m = numbering.max_case_no(_site_cases(cases, who, site), group_by=())
    # past BIGINT the exact text is the answer and max_no is NULL, never 0
    return m.select("max_no", "max_no_text")


def stats(cases: DataFrame, who: Access | None, site: str, f: CaseFilter, as_of: dt.date) -> DataFrame:
    """GET stats: total, in progress, completed, this month (status filter
    ignored, search over three columns, as the panel does)."""
    return report.stats_kpi(f.for_stats().apply(_site_cases(cases, who, site)), as_of, group_by=())


def facets(cases: DataFrame, who: Access | None, site: str) -> tuple[DataFrame, DataFrame]:
    """GET departments, GET issues: sorted distinct present values."""
    rows = _site_cases(cases, who, site)
    return report.facet(rows, "department", group_by=()), report.facet(rows, "issues", group_by=())


def report_request(cases: DataFrame, who: Access | None, site: str, f: CaseFilter = CaseFilter(),
                   top: int = 5) -> dict[str, DataFrame]:
    """GET report: summary with completion rate, every breakdown ranked with
    shares and bars (one scan for all breakdowns), and the top lists."""
    rows = f.for_report().apply(_site_cases(cases, who, site))
    breakdown = report.report_all(rows, group_by=())
    ranked = report.with_share(report.with_rank(breakdown, group_by=["dimension"]), group_by=["dimension"])
    return {
        "summary": report.report_summary(rows, group_by=()),
        "breakdowns": ranked,
        "top": report.top_n(breakdown, top, group_by=["dimension"]),
    }


# ---------------------------------------------------------------- export / import


def export_sheet(cases: DataFrame, who: Access | None, site: str, f: CaseFilter = CaseFilter()
                 ) -> tuple[DataFrame, DataFrame]:
    """GET export: (sheet rows numbered 1..n oldest first, column widths)."""
    rows = f.apply(_site_cases(cases, who, site))
    return export.export_rows(rows, per_site=False), export.sheet_widths(rows, group_by=())


def import_sheet(mapped: DataFrame, site: str, table_path: str, as_of=None, who: Access | None = None) -> dict:
    """POST import: clean and append a mapped sheet; returns the counters.
    With ``who`` the user needs can_edit on the site."""
    if who is not None and not who.may(site, "can_edit"):
        raise PermissionError(f"no can_edit permission for location {site}")
    return ingest.import_into(mapped, site, table_path, as_of=as_of)


# ---------------------------------------------------------------- case changes


def _change_rows(rows: DataFrame, op: str, seq: int) -> DataFrame:
    cols = [F.col(c) if c in rows.columns else F.lit(None).cast("date" if c == "case_date" else "string").alias(c)
            for c in CASE_FIELDS]
    loc = F.col("location") if "location" in rows.columns else F.lit(None).cast("string")
    return rows.select("id", *cols, F.lit(op).alias("op"), F.lit(seq).cast("long").alias("seq"),
                       loc.alias("location"))


def _apply(cases: DataFrame, who: Access | None, change_rows: DataFrame, as_of: dt.datetime) -> DataFrame:
    return changes.apply_changes(cases, who.changes(change_rows) if who is not None else change_rows, as_of)


def create_cases(cases: DataFrame, rows: DataFrame, as_of: dt.datetime, who: Access | None = None) -> DataFrame:
    """POST cases (batch): insert with defaults, numbering missing case_no.
    With ``who`` only on sites where the user has can_edit."""
    return _apply(cases, who, _change_rows(rows, "I", 0), as_of)


def update_cases(cases: DataFrame, rows: DataFrame, as_of: dt.datetime, who: Access | None = None) -> DataFrame:
    """PUT cases (batch): overwrite all fields of existing cases, each named
    by its site and id.  With ``who`` only on sites with can_edit."""
    return _apply(cases, who, _change_rows(rows, "U", 0), as_of)


def delete_cases(cases: DataFrame, ids: DataFrame, as_of: dt.datetime, who: Access | None = None) -> DataFrame:
    """DELETE cases (batch) by site and id.  With ``who`` only on sites with
    can_delete."""
    return _apply(cases, who, _change_rows(ids.select("id", "location"), "D", 0), as_of)


def commit_changes(spark, table_path: str, change_rows: DataFrame, as_of: dt.datetime,
                   who: Access | None = None) -> dict[str, int]:
    """Apply a change batch (op I/U/D, seq) to the stored table, replacing
    only the files it touches; returns the rows written per site.  With ``who``
    changes that the user may not make are left out."""
    from caseloom.sources.table_changes import apply_changes_to_table
    return apply_changes_to_table(spark, table_path, who.changes(change_rows) if who is not None else change_rows, as_of)


def purge(cases: DataFrame, site: str, who: Access | None = None) -> tuple[DataFrame, DataFrame]:
    """DELETE all cases of a site: (remaining table, removed count).  With
    ``who`` the user needs can_delete on the site."""
    if who is not None and not who.may(site, "can_delete"):
        raise PermissionError(f"no can_delete permission for location {site}")
    return changes.purge_site(cases, site)


# ---------------------------------------------------------------- administration


def users_page(users: DataFrame, grants: DataFrame) -> DataFrame:
    """GET admin users: users with their site lists, role order."""
    return admin.users_with_sites(users, grants)


def locations_page(locations: DataFrame, grants: DataFrame, users: DataFrame) -> DataFrame:
    """GET admin locations: sites with user counts."""
    return admin.site_user_counts(locations, grants, users)


def resolvers(users: DataFrame, grants: DataFrame, site: str) -> DataFrame:
    """GET users by location: the resolver list of a site."""
    return access.resolvers_of_site(users, grants, site)


def login_sites(users: DataFrame, grants: DataFrame, locations: DataFrame, user_id: int) -> DataFrame:
    """Sites returned at login: (code, name, short_name, can_view, can_edit,
    can_delete) -- every site with every right for a superadmin, the
    user's grants on existing sites otherwise."""
    eff = access.effective_permissions(users.filter(F.col("id") == F.lit(user_id)),
                                       grants.filter(F.col("user_id") == F.lit(user_id)), locations)
    named = locations.select(F.col("code").alias("location_code"), "name", "short_name")
    return (eff.join(named, "location_code")
               .select(F.col("location_code").alias("code"), "name", "short_name", *access.PERMISSIONS)
               .orderBy("name", "code"))


def login_audit(attempts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lockout state per user and every lock, from a login-attempt table."""
    return audit.lockout_audit(attempts), audit.lockout_events(attempts)


def valid_tokens(tokens: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Tokens a verify request could accept at ``as_of``."""
    return audit.latest_valid(tokens, as_of, supersede=True)
