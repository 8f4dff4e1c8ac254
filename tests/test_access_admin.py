import datetime as dt

from caseloom.operators import access, admin
from caseloom.schema import GRANTS, LOCATIONS, USERS

T = dt.datetime(2025, 1, 1)


def _dims(spark):
    locs = spark.createDataFrame([("s1", "Site One", "S1"), ("s2", "Site Two", "S2"), ("s3", "Empty", "S3")],
                                 LOCATIONS)
    users = spark.createDataFrame([
        (1, "root", None, "Root", "superadmin", False, None, 0),
        (2, "adm", None, "Admin", "admin", False, None, 0),
        (3, "u3", None, None, "user", False, None, 0),
        (4, "u4", None, "", "user", False, None, 0),
        (5, "lock", None, "Locked", "user", True, T, 3),
        (6, "nog", None, "No Grants", "user", False, None, 0),
    ], USERS)
    grants = spark.createDataFrame([
        (1, "s1", True, True, True), (1, "s2", True, True, True), (1, "s3", True, True, True),
        (2, "s1", True, True, True), (2, "s2", True, True, True),
        (3, "s1", True, False, False),     # view only
        (4, "s2", False, True, False),     # edit without view
        (5, "s1", True, True, True),
    ], GRANTS)
    return users, grants, locs


def test_visible_cases_only_granted_sites(spark):
    users, grants, locs = _dims(spark)
    cases = spark.createDataFrame([(1, "s1"), (2, "s2"), (3, "s3"), (4, "zz")], "id long, location string")
    vis = lambda uid, perm: sorted(r.id for r in access.visible_cases(cases, users, grants, locs, uid, perm).collect())
    assert vis(3, "can_view") == [1]
    assert vis(3, "can_edit") == []
    assert vis(4, "can_view") == [] and vis(4, "can_edit") == [2]
    assert vis(1, "can_delete") == [1, 2, 3]   # superadmin: every existing site
    assert vis(6, "can_view") == []


def test_site_user_counts_excludes_superadmin_keeps_zero(spark):
    users, grants, locs = _dims(spark)
    got = {r.code: r.user_count for r in admin.site_user_counts(locs, grants, users).collect()}
    assert got == {"s1": 3, "s2": 2, "s3": 0}


def test_users_with_sites_order_and_lists(spark):
    users, grants, _ = _dims(spark)
    rows = admin.users_with_sites(users, grants).collect()
    assert [r.eid for r in rows][:2] == ["root", "adm"]
    lists = {r.eid: r.locations for r in rows}
    assert lists["root"] == ["s1", "s2", "s3"] and lists["nog"] == []


def test_resolvers_label_and_filters(spark):
    users, grants, _ = _dims(spark)
    got = {(r.location_code, r.eid): r.display for r in access.resolvers_of_site(users, grants, "s1").collect()}
    assert got == {("s1", "adm"): "Admin (adm)", ("s1", "u3"): "u3 (u3)"}


def test_delete_users_protects_superadmin_and_cascades(spark):
    users, grants, _ = _dims(spark)
    ids = spark.createDataFrame([(1,), (3,)], "id long")
    kept_users, kept_grants = admin.delete_users(users, grants, ids)
    assert sorted(r.id for r in kept_users.collect()) == [1, 2, 4, 5, 6]
    assert 3 not in {r.user_id for r in kept_grants.collect()}
    assert kept_grants.filter("user_id = 1").count() == 3


def test_replace_grants_and_roles(spark):
    users, grants, _ = _dims(spark)
    req = spark.createDataFrame([(3, ["s2", "s3", "s2"], "admin"), (1, ["s1"], "user"), (4, [], "boss")],
                                "user_id long, codes array<string>, role string")
    g = admin.replace_grants(grants, req)
    assert sorted((r.location_code, r.can_delete) for r in g.filter("user_id = 3").collect()) == \
        [("s2", True), ("s3", True)]
    assert g.filter("user_id = 4").count() == grants.filter("user_id = 4").count() == 1  # an invalid role is refused
    roles = {r.id: r.role for r in admin.update_roles(users, req).collect()}
    assert roles[3] == "admin" and roles[1] == "superadmin" and roles[4] == "user"


def test_create_users_and_sites(spark):
    users, _, locs = _dims(spark)
    inc = spark.createDataFrame([
        (10, " u3 ", "", "A", "B", "", None),       # exists
        (11, "new", " e@x ", " Ann ", " Lee ", "", None),
        (12, "new", "", "", "", "", "admin"),      # in-batch duplicate, later id
        (13, "bad", "", "", "", "", "root"),       # invalid role
    ], "id long, eid string, email string, first_name string, last_name string, full_name string, role string")
    got = admin.create_users(inc, users).collect()
    assert [(r.id, r.eid, r.email, r.full_name, r.role) for r in got] == [(11, "new", "e@x", "Ann Lee", "user")]
    sites = spark.createDataFrame([(" NEW1 ", "N", "n", 1), ("S1", "x", "x", 2), ("ab", "x", "x", 3),
                                   ("toolongcode1", "x", "x", 4), ("new1", "dup", "d", 5)],
                                  "code string, name string, short_name string, seq long")
    assert [(r.code, r.name) for r in admin.create_sites(sites, locs).collect()] == [("new1", "N")]


def test_effective_permissions_has_no_cartesian_product(spark):
    users, grants, locs = _dims(spark)
    eff = access.effective_permissions(users, grants, locs)
    assert eff.filter("user_id = 1").count() == 3
    plan = eff._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_seed_grants_every_site(spark):
    users, _, locs = _dims(spark)
    g = admin.grants_on_all_sites(users.filter("role = 'superadmin'"), locs)
    assert sorted((r.user_id, r.location_code, r.can_view and r.can_edit and r.can_delete) for r in g.collect()) == \
        [(1, "s1", True), (1, "s2", True), (1, "s3", True)]


def test_grant_on_unknown_site_grants_nothing(spark):
    users, grants, locs = _dims(spark)
    extra = spark.createDataFrame([(3, "zz", True, True, True)], GRANTS)
    g = grants.unionByName(extra)
    eff = {(r.user_id, r.location_code) for r in access.effective_permissions(users, g, locs).collect()}
    assert (3, "zz") not in eff and (3, "s1") in eff
    cases = spark.createDataFrame([(1, "s1"), (2, "zz")], "id long, location string")
    assert [r.id for r in access.visible_cases(cases, users, g, locs, 3, "can_edit").collect()] == []
    assert [r.id for r in access.visible_cases(cases, users, g, locs, 3, "can_view").collect()] == [1]


def test_user_keys_under_the_collation(spark):
    users, _, _ = _dims(spark)
    inc = spark.createDataFrame([(10, "U3", "", "A", "B", "", None, "", " 12 "), (11, "New", "", "A", "B", "", None, "Desk", None),
                                 (12, "NEW", "", "A", "B", "", None, "Desk", None)],
                                "id long, eid string, email string, first_name string, last_name string, "
                                "full_name string, role string, position string, phone string")
    assert [(r.id, r.position) for r in admin.create_users(inc, users, collation="ci").collect()] == [(11, "Desk")]
    got = {r.id: (r.position, r.phone) for r in admin.create_users(inc, users).collect()}
    assert got == {10: (None, "12"), 11: ("Desk", None), 12: ("Desk", None)}


def test_last_valid_request_decides(spark):
    users, grants, _ = _dims(spark)
    req = spark.createDataFrame([(3, ["s1"], "user", 1), (3, ["s2"], "admin", 3), (3, ["s1", "s3"], None, 2), (3, ["s1"], "boss", 4),
                                 (2, ["s3"], "admin", 1), (2, [], None, 2), (4, ["s2"], "root", 9)],
                                "user_id long, codes array<string>, role string, seq long")
    g = admin.replace_grants(grants, req)
    assert [r.location_code for r in g.filter("user_id = 3").collect()] == ["s2"]
    assert g.filter("user_id = 2").count() == 0  # an empty list takes every right away
    assert g.filter("user_id = 4").count() == grants.filter("user_id = 4").count()
    roles = {r.id: r.role for r in admin.update_roles(users, req).collect()}
    was = {r.id: r.role for r in users.collect()}
    assert roles[3] == "admin" and roles[2] == ("superadmin" if was[2] == "superadmin" else "user") and roles[4] == was[4]
