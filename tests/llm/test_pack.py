import itertools
import random

import pytest

from heddle.llm.pack import fill_report, fullest, minimum_bin_slack, pack

from ..conftest import rows


def test_fullest_is_optimal():
    rng = random.Random(5)
    for _ in range(200):
        sizes = [rng.randrange(1, 20) for _ in range(rng.randrange(1, 9))]
        room = rng.randrange(0, 60)
        counts = {s: sizes.count(s) for s in sizes}
        used = fullest(counts, sorted(counts, reverse=True), room)
        assert all(k <= counts[s] for s, k in used.items())
        best = max(sum(c) for n in range(len(sizes) + 1) for c in itertools.combinations(sizes, n) if sum(c) <= room)
        assert sum(s * k for s, k in used.items()) == best


def test_bins():
    rng = random.Random(6)
    sizes = [rng.randrange(0, 300) for _ in range(3000)]
    place = minimum_bin_slack(sizes, 512)
    loads = {}
    for b, s in zip(place, sizes):
        loads[b] = loads.get(b, 0) + s
    assert max(loads.values()) <= 512
    assert len(loads) <= -(-sum(sizes) // 512) + 1  # within one of the least possible
    assert minimum_bin_slack([], 10) == [] and set(minimum_bin_slack([0, 0], 10)) == {0}


SIZES = "doc_id bigint, tokens bigint, capacity int, container string"


@pytest.mark.parametrize("shard_items", [50, 10_000])
def test_pack(spark, shard_items):
    rng = random.Random(8)
    docs = [(i, rng.choice([None, 0, 64, 128, rng.randrange(1, 400)]), 1, "clash") for i in range(400)]
    docs += [(7, 33, 1, "again")]
    specs = spark.createDataFrame([(1, 64), (2, 256), (3, None), (4, 0)], "spec_id int, capacity_tokens int")
    got = pack(spark.createDataFrame(docs, SIZES), specs, shard_items).collect()
    for spec, capacity in ((1, 64), (2, 256)):
        own = [r for r in got if r["spec_id"] == spec]
        loads, tokens, pieces = {}, {}, {}
        for r in own:
            loads[r["container"]] = loads.get(r["container"], 0) + r["tokens"]
            tokens[r["doc_id"]] = tokens.get(r["doc_id"], 0) + r["tokens"]
            pieces.setdefault(r["doc_id"], []).append(r["piece"])
        assert max(loads.values()) <= capacity
        want = {}
        for i, n, *_ in docs:
            want[i] = want.get(i, 0) + (n or 0)
        assert tokens == want
        for i, n, *_ in docs[:400]:
            if i != 7:
                assert sorted(pieces[i]) == list(range(max(1, -(-(n or 0) // capacity))))  # never split below the capacity
    assert {r["spec_id"] for r in got} == {1, 2}
    report = {r["spec_id"]: r for r in fill_report(pack(spark.createDataFrame(docs, SIZES), specs, 10_000)).collect()}
    assert report[2]["filled"] > 0.97 and report[2]["tokens"] == sum(n or 0 for _, n, *_ in docs)


def test_empty_and_too_many_specs(spark):
    none, specs = spark.createDataFrame([], SIZES), spark.createDataFrame([(1, 64)], "spec_id int, capacity_tokens int")
    assert pack(none, specs).count() == 0
    assert rows(pack(spark.createDataFrame([(1, 5, 1, "c")], SIZES), specs.limit(0))) == []
    with pytest.raises(ValueError):
        pack(none, spark.range(1001).selectExpr("cast(id as int) spec_id", "64 capacity_tokens"))
