import numpy as np
import pytest

from heddle.llm import hnsw
from heddle.llm.neighbors import decoded_vectors, live_codes, nearest, sound_vectors

from ..conftest import rows


def clustered(n, dim, seed):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(max(2, n // 40), dim))
    x = centers[rng.integers(0, len(centers), n)] + 0.5 * rng.normal(size=(n, dim))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


@pytest.mark.parametrize("n", [1, 2, 30, 700, 6000])
def test_graph_recall(n):
    x = clustered(n, 32, n)
    layers = hnsw.build(x)
    assert all(links.dtype == np.int32 and links.max() < len(links) for links in layers)
    found = hnsw.search(x, layers, x, 6)
    s = x @ x.T
    true = np.argsort(-s, axis=1)[:, :6]
    hits = np.mean([len(set(a) & set(b)) for a, b in zip(true.tolist(), found.tolist())]) / true.shape[1]
    assert hits > 0.97


def brute(items, k):
    out = set()
    for item, v in items:
        others = {}
        for other, w in items:
            if other != item:
                c = round(float(v @ w), 6)
                others[other] = max(c, others.get(other, -2))
        out |= {(item, o) for o, _ in sorted(others.items(), key=lambda x: (-x[1], x[0]))[:k]}
    return out


VECTOR = "collection string, item string, vector array<float>, cls string"


@pytest.mark.parametrize("options", [{}, {"shard_size": 60, "block_size": 40, "probes": 4}, {"shard_size": 60, "flat_cells": 3, "probes": 6}, {"shard_size": 60, "exact": True}])
def test_nearest(spark, options):
    x = clustered(400, 16, 3)
    x[100:230] = x[100]  # a third is one and the same vector
    data = [("a", f"i{i:03d}", (v * (1 + i % 3)).tolist(), "clash") for i, v in enumerate(x)]
    data += data[:20] + [
        ("a", "zero", [0.0] * 16, "c"), ("a", "null", None, "c"), ("a", "short", [1.0] * 15, "c"), ("a", "nan", [float("nan")] + [1.0] * 15, "c"),
        ("a", "inf", [float("inf")] + [1.0] * 15, "c"), ("a", "hole", [None] + [1.0] * 15, "c"), ("a", None, [1.0] * 16, "c"), ("b", "alone", [1.0] * 16, "c"),
    ]
    got = nearest(sound_vectors(spark.createDataFrame(data, VECTOR), 16), 5, **options).collect()
    want = brute([(f"i{i:03d}", v.astype(np.float64)) for i, v in enumerate(x)], 5)
    found = {(r["item"], r["other"]) for r in got}
    assert len(found & want) / len(want) > (1 - 1e-9 if "exact" in options else 0.98 if not options else 0.9)
    high = nearest(sound_vectors(spark.createDataFrame(data, VECTOR), 16), 5, min_cos=0.7, **options).collect()
    assert {(r["item"], r["other"]) for r in high} == {(r["item"], r["other"]) for r in got if r["cos"] >= 0.7}
    assert len(got) == len(found) == 2000 and {r["collection"] for r in got} == {"a"}
    for i in range(100, 230):  # copies are answered exactly
        assert {o for a, o in found if a == f"i{i:03d}"} == {o for a, o in want if a == f"i{i:03d}"}


@pytest.mark.parametrize("shape", ["uniform", "clusters", "balls"])
def test_recall_of_a_full_shard_by_descent(shape):
    """16,000 points in one graph, entered through its small topmost layer."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(16_000, 24))
    if shape != "uniform":
        centers = rng.normal(size=(53 if shape == "clusters" else 3, 24))
        x = centers[rng.integers(0, len(centers), len(x))] + 0.35 * x
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    layers = hnsw.build(x)
    assert len(layers) == 4 and len(layers[-1]) <= hnsw.TOP
    asked = np.arange(0, len(x), 16)
    true = np.argsort(-(x[asked] @ x.T), axis=1)[:, :6]
    for found in (hnsw.search(x, layers, x[asked], 6), hnsw.search(x, layers, x[asked], 6, own=asked)):
        assert np.mean([len(set(a) & set(b)) for a, b in zip(true.tolist(), found.tolist())]) / 6 > 0.95


def test_measured_probes_reach_the_recall(spark):
    """Many small cells of vectors without clusters: a fixed small count would lose neighbours."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 16))
    data = [("a", f"i{i:04d}", v.tolist(), "") for i, v in enumerate(x)]
    sound = sound_vectors(spark.createDataFrame(data, VECTOR), 16)
    want = {(r["item"], r["other"]) for r in nearest(sound, 5, exact=True).collect()}
    recall = lambda **o: len({(r["item"], r["other"]) for r in nearest(sound, 5, shard_size=200, **o).collect()} & want) / len(want)
    assert recall() > 0.95 > recall(probes=3)


def test_scaled_copies_are_one_group(spark):
    """Copies of one vector at many norms: float32 rounding must not hide them from one another."""
    rng = np.random.default_rng(5)
    v, noise = rng.normal(size=64), rng.normal(size=(300, 64))
    data = [("a", f"c{i:03d}", [float(np.float32(x)) for x in v * s], "") for i, s in enumerate(rng.uniform(0.01, 50, 300))]
    data += [("a", f"n{i:03d}", n.tolist(), "") for i, n in enumerate(noise)]
    got = nearest(sound_vectors(spark.createDataFrame(data, VECTOR), 64), 5).filter("item like 'c%'").collect()
    others = lambda i: [f"c{j:03d}" for j in range(7) if f"c{j:03d}" != i][:5]
    assert len(got) == 1500 and all(r["cos"] == 1.0 for r in got)
    right = sum(r["other"] in others(r["item"]) for r in got)
    assert right / len(got) > 0.95


def test_packed_vectors_are_exact():
    from heddle.llm import neighbors

    whole, real = np.array([[-7.5, 0.5, 63.5], [1, 2, 3]], np.float32), np.array([[0.1, 2, 3], [64, 0, 0]], np.float32)
    for rows_, size in ((whole, 7), (real, 25)):
        blob = neighbors._blob(rows_)
        assert len(blob) == size and (neighbors._rows(blob, 2) == rows_).all()
    assert (neighbors._matrix([neighbors._blob(r) for r in (*whole, *real)]) == np.concatenate([whole, real])).all()


def test_nothing(spark):
    assert nearest(sound_vectors(spark.createDataFrame([], VECTOR), 16)).count() == 0


SEGMENT = "seq bigint, bit_width int, dim int, upsert_stable_ids array<bigint>, upsert_codes binary, upsert_scales array<float>, removed_stable_ids array<bigint>"


def test_segments(spark):
    code = lambda b: bytes([b] * 4)  # noqa: E731  8 components of 4 bits
    segments = [
        (3, 4, 8, [5], code(0x31), [2.0], [1]),  # removes 1, writes 5 again
        (1, 4, 8, [1, 5], code(0x10) + code(0xF0), [1.0, 1.0], None),
        (1, 4, 8, [1, 5], code(0x10) + code(0xF0), [1.0, 1.0], None),  # repeated
        (2, 4, 8, [1], code(0xFF) + b"x", [1.0], [5]),  # damaged
        (4, 2, 8, [7, 8], bytes([0b11100100] * 2) * 2, [1.0], [8]),  # 8 has no scale
        (5, 4, 8, [9, 9], code(0x00) + code(0xFF), [1.0, 1.0], [9]),  # removal first, later upsert wins
        (None, 4, 8, [10], code(1), [1.0], None),
        (6, 4, 8, None, None, None, [77]),
    ]
    codes = live_codes(spark.createDataFrame(segments, SEGMENT))
    assert rows(codes, "id", "bit_width", "code", "scale") == [(5, 4, bytearray(code(0x31)), 2.0), (7, 2, bytearray(b"\xe4\xe4"), 1.0), (8, 2, bytearray(b"\xe4\xe4"), None), (9, 4, bytearray(code(0xFF)), 1.0)]
    got = {r["item"]: np.frombuffer(r["vec"], np.float32).tolist() for r in decoded_vectors(codes, "t", 8).collect()}
    assert got == {"5": [-6.5, -4.5] * 4, "7": [-1.5, -0.5, 0.5, 1.5] * 2, "9": [7.5] * 8}
    assert decoded_vectors(codes, "t", 64).count() == 0
