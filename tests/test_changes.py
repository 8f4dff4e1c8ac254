import datetime as dt

from caseloom.operators import changes
from caseloom.schema import CASES

D = dt.date(2025, 1, 1)
T = dt.datetime(2025, 1, 1)
AS_OF = dt.datetime(2025, 3, 1)
CH = ("id long, case_no string, case_date date, issues string, description string, step_to_resolve string, "
      "opened_by string, department string, status string, resolved_by string, remark string, op string, "
      "seq long, location string")


def _base(spark):
    rows = [(i, str(i), D, "I", "d", "s", "o", "IT", "Completed", "a", "r", T, T, "s1") for i in range(1, 6)]
    return spark.createDataFrame(rows, CASES)


def _changes(spark):
    def r(i, op, seq, **kw):
        v = dict(case_no=None, case_date=None, issues=None, description=None, step_to_resolve=None, opened_by=None,
                 department=None, status=None, resolved_by=None, remark=None)
        v.update({k: x for k, x in kw.items() if k != "location"})
        return (i, *v.values(), op, seq, kw.get("location", "s2" if i >= 50 else "s1"))
    return spark.createDataFrame([
        r(1, "U", 1, description="first"), r(1, "U", 2, description="second"),  # last wins
        r(2, "U", 1, description="upd"), r(2, "D", 2),                          # update then delete
        r(99, "U", 1), r(98, "D", 1),                                           # unknown ids
        r(3, "U", 1, issues="only issues"),                                      # others -> defaults
        r(50, "I", 1), r(51, "I", 1, case_no="X-1"),
    ], CH)


def test_apply_changes_semantics(spark):
    out = {r.id: r for r in changes.apply_changes(_base(spark), _changes(spark), AS_OF).collect()}
    assert set(out) == {1, 3, 4, 5, 50, 51}
    assert out[1].description == "second" and out[1].location == "s1" and out[1].updated_at == AS_OF
    assert out[1].created_at == T
    assert (out[3].issues, out[3].description, out[3].status, out[3].case_date) == ("only issues", "", "In progress", None)
    assert out[50].case_no == "1" and out[50].location == "s2"   # numbered per site (s2 has none)
    assert out[51].case_no == "X-1"
    assert out[4].description == "d"


def test_apply_changes_idempotent(spark):
    once = changes.apply_changes(_base(spark), _changes(spark), AS_OF)
    twice = changes.apply_changes(once, _changes(spark).filter("op <> 'I'"), AS_OF)
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assert key(once) == key(twice)


def test_purge_site_counts(spark):
    kept, purged = changes.purge_site(_base(spark), "s1")
    assert kept.count() == 0 and purged.collect()[0].purged == 5


def test_same_id_in_two_sites(spark):
    """Sites number their ids each; a change concerns the site it names."""
    rows = [(1, "1", D, "I", "d", "s", "o", "IT", "Completed", "a", "r", T, T, s) for s in ("s1", "s2")]
    base = spark.createDataFrame(rows + [(2, "2", D, "I", "d", "s", "o", "IT", "Completed", "a", "r", T, T, "s2")], CASES)
    ch = [(1, *[None] * 3, "upd", *[None] * 6, "U", 1, "s1"), (1, *[None] * 11, "D", 2, "s2"), (2, *[None] * 11, "D", 3, "s1"), (2, *[None] * 11, "D", 3, None)]
    ch = [(c[0], None, None, None, c[4], None, None, None, None, None, None, *c[-3:]) for c in ch]
    out = sorted((r.location, r.id, r.description) for r in changes.apply_changes(base, spark.createDataFrame(ch, CH), AS_OF).collect())
    assert out == [("s1", 1, "upd"), ("s2", 2, "d")]


def test_ops_of_one_batch_are_folded_in_order(spark):
    def r(i, op, seq, text=None, no=None):
        return (i, no, None, None, text, None, None, None, None, None, None, op, seq, "s1")

    ch = spark.createDataFrame([
        r(50, "I", 1, "new"), r(50, "U", 2, "changed"),                      # insert, then update
        r(1, "D", 1), r(1, "I", 2, "again", "N-1"),                          # delete, then insert
        r(51, "I", 1, "gone"), r(51, "D", 2),                                # insert, then delete
        r(2, "D", 1), r(2, "U", 2, "late"),                                  # update of a deleted case
        r(52, "U", 1, "early"), r(52, "I", 2, "first"), r(52, "I", 3, "second"),
        r(3, "I", 1, "exists"),
    ], CH)
    out = {x.id: x for x in changes.apply_changes(_base(spark), ch, AS_OF).collect()}
    assert set(out) == {1, 3, 4, 5, 50, 52}
    assert out[50].description == "changed" and out[50].created_at == AS_OF
    assert (out[1].description, out[1].case_no, out[1].created_at) == ("again", "N-1", AS_OF)
    assert out[52].description == "first" and out[3].description == "d"


def test_given_numbers_count_from_their_request_on(spark):
    def r(i, op, seq, no=None):
        return (i, no, *[None] * 9, op, seq, "s1")

    ch = spark.createDataFrame([r(50, "I", 1), r(51, "I", 2, "9"), r(52, "I", 3), r(1, "U", 4, "40"), r(53, "I", 5), r(54, "I", 6, "X"), r(55, "I", 7)], CH)
    out = {x.id: x.case_no for x in changes.apply_changes(_base(spark), ch, AS_OF).collect()}
    assert {i: out[i] for i in (1, 50, 51, 52, 53, 54, 55)} == {1: "40", 50: "6", 51: "9", 52: "10", 53: "41", 54: "X", 55: "42"}
