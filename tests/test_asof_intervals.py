import random

import pytest

from heddle.operators.asof import asof_versions
from heddle.operators.intervals import continuous_periods

from .conftest import rows

EVENT = "episode string, key string, t bigint, created_at bigint, id string"
VERSION = "id string, valid_at bigint, invalid_at bigint, created_at bigint, expired_at bigint, key string"


def winner(versions, key, t):
    low = -1 << 70
    ok = [
        v for v in versions
        if key is not None and t is not None and v[0] == key and v[3] is not None and v[3] <= t
        and (v[1] is None or v[1] <= t) and (v[2] is None or v[2] > t or (v[4] is not None and v[4] > t))
    ]
    best = max(ok, key=lambda v: (low if v[1] is None else v[1], v[3]), default=None)
    return (best[1], best[3]) if best else (None, None)


@pytest.mark.parametrize("rows_per_shard", [4, 100_000])
def test_versions_as_known(spark, rows_per_shard):
    rng = random.Random(7)
    some = lambda n: rng.choice([None, rng.randrange(n), rng.randrange(n)])
    versions = [("hot" if i % 2 else f"e{rng.randrange(8)}", some(60), some(80), some(60), some(90), "x") for i in range(160)]
    versions += versions[:20] + [(None, 1, None, 1, None, "x")]
    events = [(f"p{i}", "hot" if i % 3 == 0 else rng.choice([None, "e1", "e2", "unknown", ""]), some(100), i, "own id") for i in range(240)]
    got = asof_versions(spark.createDataFrame(events, EVENT), spark.createDataFrame(versions, VERSION), "key", "t", rows_per_shard=rows_per_shard)
    assert got.columns == [*EVENT.replace(" string", "").replace(" bigint", "").split(", "), "version_valid_at", "version_created_at"]
    assert len(got.collect()) == len(events)
    for r in got.collect():
        assert (r["version_valid_at"], r["version_created_at"]) == winner(versions, r["key"], r["t"]), r


def test_nested_versions_are_carried_once(spark):
    """Each version ends later than those begun after it; every shard but one would otherwise carry all of them."""
    from pyspark.sql import functions as F

    from heddle.operators import asof, sharding

    carried = {}
    for n in (400, 800, 1600):
        rows_ = [("k", i, i, i, 2 * n + (n - i)) for i in range(n)]
        v = spark.createDataFrame(rows_, "__key string, __at bigint, __valid bigint, __created bigint, __end bigint")
        cuts = sharding.hot_key_cuts(v.select("__key", "__at").unionByName(v.select("__key", F.col("__end").alias("__at"))), ["__key"], "__at", 40)
        carried[n] = asof._carry_in(sharding.with_shard(v, cuts, ["__key"], "__at"), cuts, ["__key"]).count()
        assert carried[n] <= n + cuts.select(F.size("__cuts")).first()[0]
    assert carried[1600] < 2.5 * carried[800] < 6 * carried[400]


def test_ties_of_a_hot_key_are_split(spark):
    """All events of a hot key share one time: they are dealt to several shards and keep their version."""
    from pyspark.sql import functions as F

    from heddle.operators import sharding

    versions = [("hot", 3, None, 2, None, "x"), ("hot", 5, None, 5, None, "x"), ("hot", 1, 4, 1, None, "x"), ("hot", 9, None, 9, None, "x")]
    events = [(f"p{i}", "hot", 5, i, "i") for i in range(400)] + [("q", "hot", 4, 0, "i"), ("r", "hot", 12, 0, "i")]
    e = spark.createDataFrame(events, EVENT)
    got = asof_versions(e, spark.createDataFrame(versions, VERSION), "key", "t", rows_per_shard=50)
    assert {(r["t"], r["version_created_at"], r["n"]) for r in got.groupBy("t", "version_created_at").agg(F.count("*").alias("n")).collect()} == {(5, 5, 400), (4, 2, 1), (12, 9, 1)}
    cuts = sharding.hot_key_cuts(e.select("key", "t"), ["key"], "t", 50)
    sizes = [r[1] for r in sharding.with_shard(e, cuts, ["key"], "t", sharding.row_salt(e)).groupBy("__shard").count().collect()]
    assert max(sizes) < 150


def test_open_starts_of_a_hot_key(spark):
    intervals = [("hot", None, i) for i in range(300)] + [("hot", 500, 510), ("hot", 505, None)]
    df = spark.createDataFrame(intervals, "src string, a bigint, b bigint")
    assert rows(continuous_periods(df, "src", "a", "b", 20)) == brute_periods(intervals)


def test_asof_empty(spark):
    events, versions = spark.createDataFrame([("p", "a", 5, 0, "i")], EVENT), spark.createDataFrame([], VERSION)
    assert rows(asof_versions(events, versions, "key", "t"), "episode", "version_created_at") == [("p", None)]
    assert asof_versions(events.limit(0), versions, "key", "t").count() == 0


def brute_periods(intervals):
    out = []
    low, high = -10**18, 10**18
    for key in {i[0] for i in intervals if i[0] is not None}:
        own = sorted({(low if s is None else s, high if e is None else e) for k, s, e in intervals if k == key and (s is None or e is None or e > s)})
        merged = []
        for s, e in own:
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        out += [(key, "period", -1 if s == low else s, -1 if e == high else e) for s, e in merged]
        out += [(key, "gap", a[1], b[0]) for a, b in zip(merged, merged[1:])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("rows_per_shard", [5, 100_000])
def test_periods_and_gaps(spark, rows_per_shard):
    rng = random.Random(3)
    intervals = []
    for i in range(300):
        s = rng.randrange(5000)
        intervals.append(("hot" if i % 3 else f"k{rng.randrange(20)}", s, s + rng.choice([0, 1, 5, 10, 40, -3])))
    intervals += [("hot", 10, 30), ("hot", 30, 31), ("open", None, 5), ("open", 5, 9), ("open", 20, None), ("all", None, None), (None, 1, 2), ("none", 4, 4)]
    intervals += intervals[:30]
    df = spark.createDataFrame([(*i, 1, "x") for i in intervals], "src string, a bigint, b bigint, s bigint, kind string")
    assert rows(continuous_periods(df, "src", "a", "b", rows_per_shard)) == brute_periods(intervals)


def test_no_intervals(spark):
    assert continuous_periods(spark.createDataFrame([], "src string, a bigint, b bigint"), "src", "a", "b").count() == 0
