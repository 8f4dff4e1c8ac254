from pyspark.sql import functions as F

from caseloom.operators import numbering
from caseloom.operators.export import renumber
from caseloom.plans.numbering import global_row_number


def test_global_row_number_is_1_to_n_over_many_partitions(spark):
    df = spark.range(0, 20000, 1, numPartitions=13).select((F.col("id") * 7919 % 20011).alias("id"))
    out = global_row_number(df, ["id"], num_partitions=11)
    rows = out.orderBy("id").collect()
    assert [r.row_no for r in rows] == list(range(1, 20001))


def test_row_number_per_group_with_hot_group(spark, numbering_path):
    # one group holds most rows; it is split over several partitions
    df = spark.range(0, 9000).select(F.when(F.col("id") % 10 == 0, F.lit("cold")).otherwise(F.lit("hot"))
                                     .alias("g"), F.col("id"))
    out = global_row_number(df, ["id"], partition_by=["g"], num_partitions=7)
    for g in ("hot", "cold"):
        ids = [r.row_no for r in out.filter(F.col("g") == g).orderBy("id").collect()]
        assert ids == list(range(1, len(ids) + 1))


def test_renumber_matches_window(spark, numbering_path):
    df = spark.range(0, 500).select((F.col("id") * 3).alias("id"), F.lit("x").alias("case_no"),
                                    (F.col("id") % 3).cast("string").alias("location"))
    got = {(r.location, r.id): r.case_no for r in renumber(df, partition_by=["location"]).collect()}
    from pyspark.sql import Window
    w = Window.partitionBy("location").orderBy("id")
    want = {(r.location, r.id): r.rn for r in df.withColumn("rn", F.row_number().over(w)).collect()}
    assert got == want


def test_max_case_no_numeric_not_text(spark):
    df = spark.createDataFrame([("9", "s"), ("10", "s"), ("X-7", "s"), ("007", "s"),
                                ("0" * 10 + "9" * 45, "t"), ("123", "t")], "case_no string, location string")
    got = {r.location: (r.max_no, r.max_no_text) for r in numbering.max_case_no(df).collect()}
    assert got["s"] == (10, "10")
    assert got["t"] == (None, "9" * 45)  # exact text beyond BIGINT


def test_numbering_keeps_null_groups(spark, numbering_path):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, None), (4, "a")], "id long, g string")
    got = sorted((r.id, r.row_no) for r in global_row_number(df, ["id"], partition_by=["g"]).collect())
    assert got == [(1, 1), (2, 1), (3, 2), (4, 2)]


def test_number_batch_continues_past_bigint(spark):
    tops = {"s1": "9" * 20, "s2": "9" * 18, "s3": "1" + "0" * 39, "s4": "9" * 50}
    existing = spark.createDataFrame([(i, n, s) for i, (s, n) in enumerate(tops.items())], "id long, case_no string, location string")
    batch = spark.createDataFrame([(100 + i, None, s) for i, s in enumerate([*tops, *tops])], "id long, case_no string, location string")
    got = {}
    for r in numbering.number_batch(batch, existing).orderBy("id").collect():
        got.setdefault(r.location, []).append(r.case_no)
    assert got == {s: [str(int(n) + 1), str(int(n) + 2)] for s, n in tops.items()}


def test_max_case_no_is_0_without_numbers(spark):
    df = spark.createDataFrame([("X", "s"), (None, "t"), ("7", "u")], "case_no string, location string")
    assert {r.location: (r.max_no, r.max_no_text) for r in numbering.max_case_no(df).collect()} == {"s": (0, "0"), "t": (0, "0"), "u": (7, "7")}


def test_number_batch_continues_per_site(spark, numbering_path):
    existing = spark.createDataFrame([(1, "9", "s1"), (2, "10", "s1"), (3, "C-1", "s2")],
                                     "id long, case_no string, location string")
    batch = spark.createDataFrame([(12, None, "s1"), (11, "", "s1"), (13, "77", "s1"), (14, None, "s2")],
                                  "id long, case_no string, location string")
    got = {r.id: r.case_no for r in numbering.number_batch(batch, existing).collect()}
    assert got == {11: "11", 12: "12", 13: "77", 14: "1"}


def _one_by_one(existing, batch):
    """The numbers of requests made one after another."""
    top, out = {}, {}
    for site, no in existing:
        if no and no.isascii() and no.isdigit():
            top[site] = max(top.get(site, 0), int(no))
    for seq, i, site, no in sorted(batch, key=lambda r: (r[0], r[1])):
        if not no:
            top[site] = top.get(site, 0) + 1
            no = str(top[site])
        elif no.isascii() and no.isdigit():
            top[site] = max(top.get(site, 0), int(no))
        out[i] = no
    return out


def test_given_and_missing_numbers_mixed(spark):
    existing = spark.createDataFrame([("100", "s")], "case_no string, location string")
    batch = spark.createDataFrame([(4, 1, "s", "101"), (3, 2, "s", None), (2, 3, "s", "500"), (1, 4, "s", "")], "id long, seq long, location string, case_no string")
    got = {r.seq: r.case_no for r in numbering.number_batch(batch, existing).collect()}
    assert got == {1: "101", 2: "102", 3: "500", 4: "501"}


def test_max_plus_scan_equals_one_by_one(spark):
    import random

    rng = random.Random(9)
    sites = ["a", "b", None, "c"]
    existing = [(rng.choice(sites), rng.choice(["7", "X", "0031", "", None])) for _ in range(40)] + [("c", "9" * 18), ("b", "9" * 40)]
    batch = []
    for i in range(400):
        site = rng.choice(["a", "a", "a", "b", None, "c", "new"])
        no = rng.choice([None, None, "", "Z-1", str(rng.randint(1, 500)), str(10**18 + rng.randint(-3, 3)), "0" * 3 + str(i)] if rng.random() < 0.6 else [None])
        batch.append((rng.randint(1, 150), i, site, no))
    want = _one_by_one(existing, batch)
    rows = spark.createDataFrame(batch, "seq long, id long, location string, case_no string").repartition(7)
    base = spark.createDataFrame(existing, "location string, case_no string")
    maxima = numbering.site_maxima(base)
    for parts in (1, 5, 23):
        got = {r.id: r.case_no for r in numbering.number_requests(rows, maxima, num_partitions=parts).collect()}
        assert got == want


def test_numbers_carry_between_limbs(spark):
    existing = spark.createDataFrame([("9" * 17 + "8", "s")], "case_no string, location string")
    batch = spark.createDataFrame([(i, None, "s") for i in range(3)], "id long, case_no string, location string")
    got = [r.case_no for r in numbering.number_batch(batch, existing).orderBy("id").collect()]
    assert got == ["9" * 18, "1" + "0" * 18, "1" + "0" * 17 + "1"]
