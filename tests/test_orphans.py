import random

import pytest
from pyspark.sql import functions as F

from heddle.operators.orphans import covering_end, integer_key, key_runs, month_of, orphan_counts, orphan_references
from heddle.operators.sharding import hot_key_cuts

from .conftest import rows

REFS = "ref_table string, record_id string, field string, ref string, t bigint, parent_table string, id string"
PARENTS = "parent_table string, id string, since bigint, until bigint, ref string"
MAY = 1_714_521_600_000  # 2024-05-01 UTC


def brute(refs, parents):
    out = set()
    for table, record, field, ref, t, parent_table in refs:
        if ref is None:
            continue
        own = [p for p in parents if p[0] == parent_table and p[1] == ref]
        if not own:
            reason = "missing"
        elif t is None:
            continue
        elif all(p[2] is not None and p[2] > t for p in own):
            reason = "late"
        elif not any((p[2] is None or p[2] <= t) and (p[3] is None or p[3] > t) for p in own):
            reason = "deleted"
        else:
            continue
        out.add((table, record, field, reason, t))
    return out


def test_integer_keys_are_reversible(spark):
    ids = ["a-1", "a-01", "a-0a", "x", "", "7", "ab12\n", "é9", "f" * 40, "A-1", "a-1 "]
    df = spark.createDataFrame([(i,) for i in ids], "id string")
    got = df.select("id", *[c.alias(n) for n, c in integer_key(F.col("id")).items()]).collect()
    assert len({(r["stem"], r["width"], r["value"]) for r in got}) == len(ids)
    for r in got:
        digits = f"{r['value']:x}".rjust(r["width"], "0") if r["width"] else ""
        assert r["stem"] + digits == r["id"]


def test_runs_are_contiguous(spark):
    df = spark.createDataFrame([("g", v) for v in (1, 2, 3, 3, 7, 9, 10)] + [("g", None)], "g string, value bigint")
    assert rows(key_runs(df, ["g"]), "run_start", "run_end") == [(1, 3), (7, 7), (9, 10)]


@pytest.mark.parametrize("rows_per_shard", [3, 10_000])
def test_against_brute_force(spark, rows_per_shard):
    rng = random.Random(rows_per_shard)
    parents, refs = [], []
    for _ in range(150):
        since = rng.choice([None, rng.randrange(100)]) if rng.random() < 0.1 else rng.randrange(100)
        parents.append(("nodes", f"n-{rng.randrange(30):03x}", since, rng.choice([None, rng.randrange(120)]), "clash"))
    for i in range(400):
        ref = "n-005" if i % 3 == 0 else rng.choice([None, "", "n-0ff", f"n-{rng.randrange(45):03x}"])  # a third points at one parent
        refs.append(("edges", f"e{i % 300}", rng.choice(["src", "dst"]), ref, rng.choice([None, rng.randrange(120)]), "nodes"))
    got = orphan_references(
        spark.createDataFrame([(*r, "clash") for r in refs], REFS).select("ref_table", "record_id", "field", "ref", "t", "parent_table"),
        spark.createDataFrame(parents, PARENTS),
        rows_per_shard,
    )
    want = {(a, b, c, r, "unknown" if t is None else "1970-01") for a, b, c, r, t in brute(refs, parents)}
    assert {tuple(r) for r in got.collect()} == want


def test_empty_tables(spark):
    refs = spark.createDataFrame([("f", "1", "src", "x", MAY, "p")], "ref_table string, record_id string, field string, ref string, t bigint, parent_table string")
    none = spark.createDataFrame([], "parent_table string, id string, since bigint, until bigint")
    assert rows(orphan_references(refs, none)) == [("f", "1", "src", "missing", "2024-05")]
    assert orphan_references(refs.limit(0), none).count() == 0
    assert rows(orphan_counts(orphan_references(refs, none))) == [("f", "2024-05", "missing", 1)]


def test_months_are_utc(spark):
    df = spark.createDataFrame([(MAY,), (MAY - 1,), (None,), (-1,)], "t bigint").select(month_of(F.col("t")).alias("m"))
    assert [r[0] for r in df.collect()] == ["2024-05", "2024-04", "unknown", "1969-12"]


def test_hot_keys_are_cut(spark):
    points = spark.createDataFrame([("hot", i) for i in range(100)] + [("cold", i) for i in range(5)], "k string, t bigint")
    cuts = hot_key_cuts(points, ["k"], "t", rows_per_shard=20).collect()
    assert [r["k"] for r in cuts] == ["hot"] and 3 <= len(cuts[0]["__cuts"]) <= 5
    assert hot_key_cuts(points, ["k"], "t", rows_per_shard=200) is None


def test_covering_end_carries_over_shards(spark):
    runs = spark.createDataFrame([("k", 0, 95), ("k", 10, 12)], "g string, run_start bigint, run_end bigint")
    refs = spark.createDataFrame([("k", i) for i in range(100)], "g string, at bigint")
    cuts = hot_key_cuts(refs.withColumnRenamed("at", "t"), ["g"], "t", rows_per_shard=10)
    got = covering_end(refs, runs, ["g"], "at", cuts)
    assert {r["cover_end"] for r in got.collect()} == {95}


def test_ties_of_a_hot_reference(spark):
    refs = [("f", f"r{i}", "src", "p", t, "p") for i in range(300) for t in (7,)] + [("f", "early", "src", "p", 3, "p"), ("f", "late", "src", "p", 20, "p")]
    parents = [("p", "p", 5, 9, "x"), ("p", "p", 5, 6, "x"), ("p", "p", 8, 10, "x")]
    got = orphan_references(spark.createDataFrame(refs, REFS.rsplit(", ", 1)[0]), spark.createDataFrame(parents, PARENTS), 30)
    assert {(r["record_id"], r["reason"]) for r in got.collect()} == {("early", "late"), ("late", "deleted")}
