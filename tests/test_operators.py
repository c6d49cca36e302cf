"""Operators against brute-force versions on small hand-made frames."""

import datetime as dt
import math
import random
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from subledger.functions import business_date, duration_bin, exact_sum, net_of_vat, safe_corr, utc_ntz_of_text
from subledger.operators.intervals import intervals_hit_by_other_points
from subledger.operators.quality import count_compare, dedupe_by_key, duplicate_keys
from subledger.operators.quantiles import quantiles, values_at_ranks
from subledger.operators.running import row_position, running_sum


def _skewed(spark, n=3000, seed=7):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        g = 1 if rnd.random() < 0.4 else rnd.randint(2, 60)  # group 1 holds ~40 % of rows
        if rnd.random() < 0.02:
            g = None
        rows.append((g, rnd.randint(0, 50), i, rnd.random()))
    return spark.createDataFrame(rows, "g int, d int, k int, v double")


@pytest.mark.parametrize("hot_rows", [10**9, 50])
def test_row_position_matches_row_number(spark, hot_rows):
    df = _skewed(spark)
    order = [F.col("d").asc_nulls_first(), F.col("k").asc_nulls_first()]
    got = row_position(df, ["g"], order, "pos", hot_rows=hot_rows, num_partitions=7)
    want = df.withColumn("pos", F.row_number().over(Window.partitionBy("g").orderBy(*order)))
    assert got.count() == df.count()
    assert sorted(map(tuple, got.select("g", "k", "pos").collect()), key=repr) == sorted(
        map(tuple, want.select("g", "k", "pos").collect()), key=repr
    )


def test_running_sum_hot_path_values(spark):
    df = _skewed(spark)
    order = [F.col("d"), F.col("k")]
    got = running_sum(df, ["g"], order, F.col("v"), "run", hot_rows=20, num_partitions=5)
    w = Window.partitionBy("g").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    want = {(r.g, r.k): r.run for r in df.withColumn("run", F.sum("v").over(w)).collect()}
    for r in got.collect():
        assert abs(want[(r.g, r.k)] - r.run) < 1e-9


@pytest.mark.parametrize("nparts", [6, None])
def test_running_sum_without_groups(spark, nparts):
    # None: partition count left to AQE (adjacent range partitions merged)
    df = spark.range(0, 5000, numPartitions=8).select(((F.col("id") * 37) % 5000).alias("x"))
    got = running_sum(df, [], [F.col("x")], F.lit(1), "n", num_partitions=nparts)
    assert all(r.n == r.x + 1 for r in got.collect())


def _nearest_rank(values, p):
    v = sorted(x for x in values if x is not None)
    if not v:
        return None
    import math

    return v[max(1, math.ceil(p * len(v))) - 1]


def _interp(values, p):
    v = sorted(x for x in values if x is not None)
    pos = p * (len(v) - 1)
    lo, hi = int(pos // 1), int(-(-pos // 1))
    return v[lo] + (v[hi] - v[lo]) * (pos - lo)


def test_quantiles_disc_and_cont(spark):
    rnd = random.Random(3)
    vals = [rnd.choice([None, rnd.randint(0, 40), rnd.random() * 100]) for _ in range(777)]
    vals = [float(x) if x is not None else None for x in vals]
    df = spark.createDataFrame([(x,) for x in vals], "x double")
    probs = [0.0, 0.25, 0.5, 0.75, 1.0]
    d = quantiles(df, "x", probs, ["a", "b", "c", "d", "e"], method="disc").first()
    assert list(d) == [_nearest_rank(vals, p) for p in probs]
    c = quantiles(df, "x", [0.25, 0.5, 0.75], ["a", "b", "c"], method="cont", reread=True).first()
    for got, p in zip(c, [0.25, 0.5, 0.75]):
        assert abs(got - _interp(vals, p)) < 1e-9


def test_quantiles_empty_input_gives_null(spark):
    df = spark.createDataFrame([(None,)], "x double")
    assert list(quantiles(df, "x", [0.5], ["m"]).first()) == [None]


@pytest.mark.parametrize("kind,buckets,listed", [("double", 4, 3), ("bigint", 3, 1), ("decimal(25,3)", 7, 2), ("double", 2048, 10_000)])
def test_values_at_every_rank(spark, kind, buckets, listed):
    rnd = random.Random(5)
    vals = [rnd.choice([0, 1, 1, 7, rnd.randint(-5, 5), rnd.randint(0, 10**15), 2**62 + rnd.randint(0, 3)]) for _ in range(150)]
    if kind == "double":
        vals = [float(v) + rnd.choice([0.0, 0.25, 1e-9]) for v in vals]
    df = spark.createDataFrame([(str(v),) for v in vals], "s string").select(F.col("s").cast(kind).alias("x")).coalesce(3)
    want = sorted(r.x for r in df.collect())
    some = [1, 2, 40, 75, 76, 110, 149, 150]
    assert values_at_ranks(df, some, buckets, listed) == {r: want[r - 1] for r in some}
    with pytest.raises(ValueError):
        values_at_ranks(df, [151])


def test_ranks_with_infinities_and_nan(spark):
    inf = float("inf")
    df = spark.createDataFrame([(v,) for v in [inf, 3.0, -inf, float("nan"), 1.0, -1.7e308, 1.7e308, 2.0]], "x double")
    got = values_at_ranks(df, list(range(1, 9)), buckets=3, listed=1)
    assert [got[r] for r in range(1, 8)] == [-inf, -1.7e308, 1.0, 2.0, 3.0, 1.7e308, inf] and got[8] != got[8]


def test_selection_sorts_and_shuffles_no_values(spark):
    """Between the scan and the result there is only the aggregation of a pass."""
    df = spark.range(100_000).select((F.col("id") * 7919 % 100_003).cast("double").alias("x"))
    assert quantiles(df, "x", [0.0, 0.5, 0.999], ["a", "b", "c"]).first() == quantiles(df, "x", [0.0, 0.5, 0.999], ["a", "b", "c"], reread=True).first()
    plan = quantiles(df, "x", [0.5], ["a"])._jdf.queryExecution().toString()
    assert "Sort" not in plan and "Exchange" not in plan


@pytest.mark.parametrize("accuracy", [20, 1000])
def test_approximate_quantiles_within_their_rank_error(spark, accuracy):
    rnd = random.Random(9)
    vals = sorted(rnd.choice([rnd.lognormvariate(0, 3), float(rnd.randint(0, 9))]) for _ in range(5000))
    df = spark.createDataFrame([(v,) for v in rnd.sample(vals, len(vals))] + [(None,)] * 50, "x double").repartition(9)
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = quantiles(df, "x", probs, list("abcdefg"), method="approx", accuracy=accuracy).first()
    for p, v in zip(probs, got):
        ranks = [i for i, x in enumerate(vals, 1) if x == v]
        assert ranks[0] - len(vals) / accuracy - 1 <= max(1, p * len(vals)) <= ranks[-1] + len(vals) / accuracy + 1
    assert list(quantiles(df.where("x IS NULL"), "x", [0.5], ["m"], method="approx").first()) == [None]


def test_exact_sum_equals_a_decimal_sum(spark):
    rnd = random.Random(4)
    vals = [rnd.choice([rnd.randint(-10**6, 10**6) / 100 / 1.2, rnd.random() * 10 ** rnd.randint(-9, 12), -rnd.random(), None]) for _ in range(3000)]
    df = spark.createDataFrame([(i % 7, v) for i, v in enumerate(vals)], "g int, x double").repartition(5)
    old = F.sum(F.col("x").cast("decimal(28,8)")).cast("double").alias("old")
    for r in df.groupBy("g").agg(exact_sum("x").alias("new"), old).collect():
        assert r.new == r.old
    assert df.where("x IS NULL").agg(exact_sum("x")).first()[0] is None
    for bad in (float("nan"), float("inf"), 1e16):
        with pytest.raises(Exception, match="cannot add"):
            spark.createDataFrame([(bad,)], "x double").agg(exact_sum("x")).collect()


def test_dedupe_and_duplicates(spark):
    df = spark.createDataFrame(
        [(1, "b", None), (1, "a", 3), (1, "a", None), (None, "x", 1), (None, "y", 1), (2, "z", 0)], "k int, s string, n int"
    )
    kept = {r.k: (r.s, r.n) for r in dedupe_by_key(df, "k").collect()}
    assert kept == {1: ("a", None), None: ("x", 1), 2: ("z", 0)}
    dups = {r.k: r.cnt for r in duplicate_keys(df, "k").collect()}
    assert dups == {1: 3, None: 2}
    cc = {r.layer: r.cnt for r in count_compare({"L2": df.where("k = 1"), "L1": df}).collect()}
    assert cc == {"L2": 3, "L1": 6}


def test_intervals_against_pairs(spark):
    rnd = random.Random(11)
    base = dt.date(2023, 1, 1)
    rows = []
    for i in range(400):
        g = rnd.choice([1, 1, 1, 2, 3, None])
        lo = base + dt.timedelta(days=rnd.randint(0, 60))
        hi = lo + dt.timedelta(days=rnd.randint(-3, 40))
        rows.append((g, rnd.randint(1, 8), rnd.choice(["t1", "t2"]), lo, hi, rnd.random() < 0.2))
    df = spark.createDataFrame(rows, "g int, pid int, typ string, lo date, hi date, is_point boolean")
    points = df.where("is_point")
    for hot in (10**9, 5):
        got = intervals_hit_by_other_points(df, points, "g", "pid", "lo", "hi", "hi", keep_cols=["typ"], hot_rows=hot)
        got = sorted(map(tuple, got.select("g", "pid", "typ", "lo", "hi").collect()))
        want = set()
        for g, pid, typ, lo, hi, _ in rows:
            for pg, ppid, _, _, at, isp in rows:
                if isp and g is not None and pg == g and ppid != pid and lo <= at <= hi:
                    want.add((g, pid, typ, lo, hi))
        assert got == sorted(want)


def test_intervals_repeated_rows_and_one_exchange(spark):
    """Repeated points and intervals change nothing, and no shuffle but the group's makes them distinct."""
    d = dt.date
    rows = [(1, 1, "a", d(2023, 1, 1), d(2023, 2, 1), True), (1, 2, "b", d(2023, 1, 1), d(2023, 2, 1), False)] * 3
    rows += [(1, 3, "c", d(2023, 2, 2), d(2023, 3, 1), False), (2, 1, "a", d(2023, 1, 1), d(2023, 2, 1), True)] * 2
    df = spark.createDataFrame(rows, "g int, pid int, typ string, lo date, hi date, is_point boolean")
    for hot in (10**9, 3):
        got = intervals_hit_by_other_points(df, df.where("is_point"), "g", "pid", "lo", "hi", "hi", keep_cols=["typ"], hot_rows=hot)
        assert list(map(tuple, got.collect())) == [(1, 2, "b", d(2023, 1, 1), d(2023, 2, 1))]
        if hot > len(rows):
            assert got._jdf.queryExecution().sparkPlan().toString().count("HashAggregate") == 2
            assert len(re.findall(r"Exchange hashpartitioning", got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0])) == 1


def test_business_date_dst_and_session_zone(spark):
    cases = [
        ("2023-03-25 22:59:59", "2023-03-25"),
        ("2023-03-25 23:00:00", "2023-03-26"),
        ("2023-03-26 01:00:00", "2023-03-26"),
        ("2023-07-01 21:59:59", "2023-07-01"),
        ("2023-07-01 22:00:00", "2023-07-02"),
        ("2023-07-01 22:30:00", "2023-07-02"),
        ("2023-01-01 22:30:00", "2023-01-01"),
        ("2023-01-01 23:00:00", "2023-01-02"),
        ("2023-10-28 21:59:59", "2023-10-28"),
        ("2023-10-28 22:00:00", "2023-10-29"),
        # inside New York's spring-forward gap: must not shift with the session zone
        ("2023-03-12 02:30:00", "2023-03-12"),
        ("2023-03-11 22:59:59.5", "2023-03-11"),
    ]
    df = spark.createDataFrame([(a,) for a, _ in cases], "s string").select(F.to_timestamp_ntz("s").alias("ts"), "s")
    for zone in ("UTC", "America/New_York", "Asia/Tokyo"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        got = {r.s: r.d.isoformat() for r in df.select("s", business_date("ts").alias("d")).collect()}
        assert got == dict(cases), zone
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")


def test_duration_bins_edges(spark):
    days = [None, -5, 0, 30, 31, 61, 62, 183, 184, 365, 366, 1230, 1231]
    df = spark.createDataFrame([(d,) for d in days], "d int")
    got = [r.b for r in df.select(duration_bin("d").alias("b")).collect()]
    assert got == ["Y2+", "M1", "M1", "M1", "M2", "M2", "M3", "M6", "M6-M12", "M6-M12", "Y1-Y2", "Y1-Y2", "Y2+"]


def test_net_of_vat_and_rounding(spark):
    df = spark.createDataFrame([(None,), (-3.0,), (0.0,), (120.0,)], "a double")
    got = [r.n for r in df.select(net_of_vat("a").alias("n")).collect()]
    assert got == [None, 0.0, 0.0, 100.0]
    # half away from zero, as the warehouse casts money to whole units
    r = spark.createDataFrame([(2.5,), (-2.5,), (3.5,)], "x double").select(F.round("x").cast("long").alias("r"))
    assert [x.r for x in r.collect()] == [3, -3, 4]


def test_safe_corr_edge_cases(spark):
    def corr(rows):
        return spark.createDataFrame(rows, "a double, b double").agg(safe_corr("a", "b").alias("c")).first().c

    # no variance on one side: NaN; fewer than two pairs: NULL
    assert math.isnan(corr([(1.0, 2.0), (1.0, 3.0), (None, 9.0)]))
    assert math.isnan(corr([(0.1, 2.0), (0.1, 3.0), (0.1, 4.0)]))
    assert corr([(1.0, 2.0), (None, 9.0)]) is None and corr([(None, 2.0)]) is None
    rows = [(1.0, 2.0), (2.0, 4.1), (3.0, 5.9), (None, 100.0)]
    df = spark.createDataFrame(rows, "a double, b double")
    want = df.where("a is not null").agg(F.corr("a", "b")).first()[0]
    assert abs(corr(rows) - want) < 1e-12


def test_exact_sum_does_not_depend_on_order(spark):
    rnd = random.Random(2)
    values = [rnd.choice([1e7, 0.1, -0.3, 1 / 3, None]) for _ in range(4000)]
    sums = set()
    for n in (1, 3, 8):
        rnd.shuffle(values)
        df = spark.createDataFrame([(v,) for v in values], "x double").repartition(n)
        sums.add(df.agg(exact_sum("x")).first()[0])
    assert len(sums) == 1
    assert abs(sums.pop() - math.fsum(v for v in values if v is not None)) < 1e-4


def test_position_is_a_long_and_offsets_stay_below_partitions(spark):
    # one hot contract with very many products: only groups that cross a partition edge need an offset
    df = spark.range(6000).select(F.lit(1).alias("g"), (F.col("id") % 1500).alias("p"), F.col("id").alias("k"))
    hot = spark.createDataFrame([(1,)], "g int")
    got = row_position(df, ["g", "p"], ["k"], "pos", hot_keys=hot, num_partitions=5)
    assert dict(got.dtypes)["pos"] == "bigint"
    assert {(r.p, r.pos, r.k) for r in got.collect()} == {(k % 1500, k // 1500 + 1, k) for k in range(6000)}
    plan = got._jdf.queryExecution().executedPlan().toString()
    sent = [x for x in plan.splitlines() if "BroadcastExchange" in x]
    assert sent  # offsets are sent; their number is checked on the frame itself
    from subledger.operators import running

    ranged = df.repartitionByRange(5, "g", "p", "k").withColumn("pid", F.spark_partition_id())
    first = ranged.select("pid", "p").distinct().groupBy("p").count().where("count > 1").count()
    assert first <= 4 and running.DEFAULT_HOT_ROWS > 0


def test_text_dates_count_their_offset(spark):
    cases = {
        "2023-07-31 23:30:00+05:00": "2023-07-31 18:30:00",
        "2023-01-31T22:30:00Z": "2023-01-31 22:30:00",
        "2023-01-31 22:30:00+0200": "2023-01-31 20:30:00",
        "2023-01-31 22:30:00.25 UTC": "2023-01-31 22:30:00.250000",
        "2023-01-31T22:30:00": "2023-01-31 22:30:00",
        "2023-01-31 22:30:00-03": "2023-02-01 01:30:00",
        "2023-07-31": "2023-07-31 00:00:00",
        " 2023-07-31 ": "2023-07-31 00:00:00",
        "31.7.2023": "None",
        "": "None",
    }
    df = spark.createDataFrame([(c,) for c in cases], "s string")
    for zone in ("UTC", "America/New_York", "Asia/Tokyo"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        got = {r.s: str(r.t) for r in df.select("s", utc_ntz_of_text("s", strict=False).alias("t")).collect()}
        assert got == cases, zone
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
