import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from heddle.operators import ann, fusion, lexical, multivec
from heddle.operators.vector_search import batch_arrays, exact_topk, hydrate
from heddle.plans.search import resolve_mode, search

from .conftest import rows

RNG = np.random.default_rng(4)
POINTS = RNG.normal(size=(120, 8)).round(3)
POINTS[50] = POINTS[10]  # a tie


@pytest.fixture(scope="module")
def corpus(spark):
    data = [(f"d{i:03d}", [float(x) for x in p], "clash", i % 3) for i, p in enumerate(POINTS)]
    data += [("null", None, "c", 0), ("short", [1.0], "c", 0)]
    return spark.createDataFrame(data, "document_id string, vector array<float>, query_id string, kind int")


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame([(i, [float(x) for x in POINTS[i]]) for i in (10, 20)] + [(99, None)], "query_id int, vector array<double>")


def brute_topk(query, k, keep=lambda i: True, cosine=False):
    p32, q = POINTS.astype(np.float32).astype(float), POINTS[query]
    score = lambda p: float(q @ p) / (np.linalg.norm(q) * np.linalg.norm(p) if cosine else 1)
    scored = sorted(((-round(score(p), 6), f"d{i:03d}") for i, p in enumerate(p32) if keep(i)))
    return [(d, round(-s, 6)) for s, d in scored[:k]]


@pytest.mark.parametrize("metric", ["dot", "cosine"])
def test_exact(corpus, queries, metric):
    got = exact_topk(queries, corpus.filter("kind <> 1").repartition(5), 7, metric=metric).collect()
    for q in (10, 20):
        own = sorted((r["rank"], r["document_id"], round(r["score"], 6)) for r in got if r["query_id"] == q)
        assert [(d, s) for _, d, s in own] == brute_topk(q, 7, lambda i: i % 3 != 1, metric == "cosine")
    assert {r["query_id"] for r in got} == {10, 20}


def test_exact_edges(corpus, queries):
    assert exact_topk(queries, corpus, 1000).count() == 240
    assert exact_topk(queries.limit(0), corpus, 3).count() == 0 and exact_topk(queries, corpus.limit(0), 3).count() == 0
    with pytest.raises(ValueError):
        exact_topk(queries, corpus, 0)
    arrays = {r["query_id"]: r["ids"] for r in batch_arrays(exact_topk(queries, corpus, 3)).collect()}
    assert arrays[10] == [d for d, _ in brute_topk(10, 3)]
    assert hydrate(exact_topk(queries, corpus, 3), corpus.select("document_id", "kind").filter("kind = 0")).count() < 6


def test_two_stage(corpus, queries):
    sound = corpus.filter("document_id like 'd%'").select("document_id", "vector")
    full = rows(ann.two_stage_topk(queries.filter("query_id < 99"), sound, 5, 40.0))
    assert full == rows(exact_topk(queries, sound, 5))
    with pytest.raises(ValueError):
        ann.two_stage_topk(queries, sound, 5, 0.5)
    coarse = queries.sparkSession.createDataFrame([(10, "d001", 9.0), (10, "lost", 8.0)], "query_id int, document_id string, score double")
    again = {r["document_id"]: r["score"] for r in ann.rescore(coarse, sound, queries, 5).collect()}
    assert again["lost"] == 8.0 and again["d001"] != 9.0


def test_clusters(corpus, queries):
    sound = corpus.filter("document_id like 'd%'").select("document_id", "vector")
    centroids = ann.build_centroids(sound, "document_id", clusters=6)
    assigned = ann.assign(sound, centroids, "document_id")
    every = ann.ann_topk(queries.filter("query_id < 99"), assigned, centroids, 5, nprobe=6)
    assert rows(every) == rows(exact_topk(queries, sound, 5))
    assert ann.ann_topk(queries.filter("query_id < 99"), assigned, centroids, 120, nprobe=1).count() == 240  # probes on until there are k
    assert (ann.cluster_count(100), ann.cluster_count(0), ann.default_nprobe(10)) == (10, 1, 4)
    assert not ann.use_clusters(100, 10, 4, filtered=True) and not ann.use_clusters(100, 10, 4, False, 50) and ann.use_clusters(100, 10, 4, False, 49)


def test_default_probes_reach_the_recall(spark):
    points = np.random.default_rng(11).normal(size=(600, 16))
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    sound = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "document_id int, vector array<double>")
    asked = sound.filter("document_id % 5 = 0").select(F.col("document_id").alias("query_id"), "vector")
    centroids = ann.build_centroids(sound, "document_id")
    got = rows(ann.ann_topk(asked, ann.assign(sound, centroids, "document_id"), centroids, 10), "query_id", "document_id")
    want = rows(exact_topk(asked, sound, 10), "query_id", "document_id")
    assert len(want) == 1200 and len(set(got) & set(want)) >= 0.9 * len(want)


def test_bm25(spark):
    rng = random.Random(2)
    docs = {f"u{i:02d}": [rng.choice("abcdefgh") for _ in range(rng.randrange(0, 12))] for i in range(40)}
    units = spark.createDataFrame([(u, t, int(u[1:]) % 2) for u, t in docs.items()], "chunk_id string, tokens array<string>, odd int")
    asked = {1: ["a", "b", "b"], 2: ["h"], 3: ["zzz"], 4: []}
    queries = spark.createDataFrame(list(asked.items()), "query_id int, tokens array<string>")
    n, avg = len(docs), sum(map(len, docs.values())) / len(docs)

    def brute(terms, keep):
        scores = {}
        for t in set(terms):
            df = sum(t in d for d in docs.values())
            for u, d in docs.items():
                if t in d and keep(u):
                    tf, idf = d.count(t), math.log(1 + (n - df + 0.5) / (df + 0.5))
                    scores[u] = scores.get(u, 0) + idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / avg))
        return sorted((-round(s, 6), u) for u, s in scores.items())[:5]

    for allowed, keep in ((None, lambda u: True), (F.col("odd") == 1, lambda u: int(u[1:]) % 2)):
        got = lexical.bm25_topk(queries, units, 5, allowed=allowed).collect()
        for q, terms in asked.items():
            own = [(-r["score"], r["chunk_id"]) for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])]
            assert own == brute(terms, keep)
    local = lexical.bm25_topk(queries, units, 5, allowed=F.col("odd") == 1, stats_scope="filtered")
    assert rows(local) == rows(lexical.bm25_topk(queries, units.filter("odd = 1"), 5))
    grouped = units.withColumn("document_id", F.col("chunk_id"))
    fresh = spark.createDataFrame([("u01", ["a"], 1, "u01")], grouped.schema)
    replaced = lexical.replace_groups(grouped, fresh)
    assert replaced.count() == 40 and rows(replaced.filter("chunk_id = 'u01'"), "tokens") == [(["a"],)]


def ranked(spark, lists):
    data = [(1, n, i + 1, i, x) for n, ids in enumerate(lists) for i, x in enumerate(ids)]
    return spark.createDataFrame(data, "query_id int, list_id int, rank int, position int, id string")


def test_fusions(spark):
    lists = ranked(spark, [["a", "b", "a"], ["c", "b"]])
    got = {r["id"]: r["score"] for r in fusion.rrf(lists, "id").collect()}
    assert got == pytest.approx({"a": 1 / 61, "b": 2 / 62, "c": 1 / 61})
    assert [r["id"] for r in fusion.rrf(lists, "id").orderBy("rank").collect()] == ["b", "a", "c"]
    other = fusion.rrf_positions(lists, "id").orderBy("rank").collect()
    assert [(r["id"], round(r["score"], 6)) for r in other] == [("a", round(1 + 1 / 3, 6)), ("b", 1.0), ("c", 1.0)]


def test_mmr_and_rerankers(spark):
    data = [(1, i, x, v, [1.0, 0.0]) for i, (x, v) in enumerate([("a", [1.0, 0.0]), ("b", [1.0, 0.0]), ("c", [0.6, 0.8]), ("z", [0.0, 0.0])])]
    c = spark.createDataFrame(data, "query_id int, position int, id string, vector array<double>, query_vector array<double>")
    got = {r["id"]: (r["rank"], r["score"]) for r in fusion.maximal_marginal_relevance(c, "id", 0.5).collect()}
    assert got["a"][1] == pytest.approx(0.0) and got["c"][1] == pytest.approx(0.0) and got["z"][1] == 0.0
    assert [got[x][0] for x in "abcz"] == [1, 2, 3, 4]
    places = c.select("query_id", "position", "id")
    near = spark.createDataFrame([("c", 1), ("a", 2)], "id string, hops int")
    assert [r["id"] for r in fusion.distance_rerank(places, near, "id").orderBy("rank").collect()] == ["c", "a", "b", "z"]
    counts = spark.createDataFrame([("b", 3)], "id string, mentions bigint")
    assert [r["id"] for r in fusion.mentions_rerank(places, counts, "id").orderBy("rank").collect()] == ["b", "a", "c", "z"]


def test_maxsim(spark):
    rng = np.random.default_rng(1)
    docs = {i: rng.normal(size=(rng.integers(1, 5), 4)) for i in range(12)}
    df = spark.createDataFrame([(i, p.tolist()) for i, p in docs.items()] + [(50, []), (51, None)], "document_id int, patches array<array<double>>")
    q = rng.normal(size=(3, 4))
    asked = spark.createDataFrame([(1, q.tolist()), (2, [])], "query_id int, patches array<array<double>>")
    got = multivec.maxsim_topk(asked, df, 5).collect()
    want = sorted(((-round(float((q @ p.T).max(1).sum()), 6), i) for i, p in docs.items()))[:5]
    assert [(-r["score"], r["document_id"]) for r in sorted(got, key=lambda r: r["rank"])] == want
    pooled = {r["document_id"]: r["vector"] for r in multivec.mean_pool(df).collect()}
    mean = docs[3].mean(0)
    assert np.allclose(pooled[3], mean / np.linalg.norm(mean)) and set(pooled) == set(docs)
    opposite = spark.createDataFrame([(1, [[1.0, 0.0], [-1.0, 0.0]])], "document_id int, patches array<array<double>>")
    assert rows(multivec.mean_pool(opposite), "vector") == [([1.0, 0.0],)]


def test_search_modes(spark):
    from heddle.functions.text import hash_embedding_column, tokenize

    texts = {"a": "alpha beta zq-77", "b": "beta gamma", "c": "gamma delta", "d": "zq-77 zq-77"}
    docs = spark.createDataFrame([(i, {"kind": "x" if i in "ad" else "y"}) for i in texts], "document_id string, metadata map<string,string>")
    chunks = spark.createDataFrame(list(texts.items()), "document_id string, text string").select(
        "document_id", F.col("document_id").alias("chunk_id"), tokenize(F.col("text")).alias("tokens"), hash_embedding_column(F.col("text"), 16).alias("vector")
    )
    queries = spark.createDataFrame([(1, "zq-77"), (2, "gamma")], "query_id int, text string")
    for mode in ("vector", "lexical", "hybrid"):
        both = search(docs, chunks, queries, 2, mode=mode, dim=16)
        single = [rows(search(docs, chunks, queries.filter(f"query_id = {q}"), 2, mode=mode, dim=16).hits) for q in (1, 2)]
        assert rows(both.hits) == sorted(single[0] + single[1], key=repr)
    hits = search(docs, chunks, queries, 3, filter={"kind": "y"}, mode="hybrid", dim=16)
    assert {r["document_id"] for r in hits.hits.collect()} == {"b", "c"} and hits.total_considered.first()[0] == 2
    lex = search(docs, chunks, queries, 3, mode="lexical").hits
    assert [r["document_id"] for r in lex.filter("query_id = 1").orderBy("rank").collect()] == ["d", "a"]
    assert (resolve_mode(None, True), resolve_mode(None, False)) == ("hybrid", "vector")
    with pytest.raises(ValueError):
        resolve_mode("lexical", False)


def test_exact_search_does_not_lose_close_scores(spark):
    """Scores that differ only beyond single precision, large values, ties and huge numbers."""
    import numpy as np

    from heddle.operators.vector_search import _dot_hits

    rng = np.random.default_rng(3)
    for scale in (1.0, 1e6, 1e30, 1e200):
        base = rng.normal(size=48)
        c = np.concatenate([base + 1e-9 * rng.normal(size=(300, 48)), rng.normal(size=(300, 48)), np.tile(base, (20, 1))]) * scale
        q = np.concatenate([base[None], rng.normal(size=(4, 48))])
        at_q, at_c, got = _dot_hits(q, c, 7, 6)
        true = np.round(q @ c.T, 6)
        for i in range(len(q)):
            kth = np.sort(true[i])[-7]
            found = dict(zip(at_c[at_q == i].tolist(), got[at_q == i]))
            need = np.flatnonzero(true[i] > kth * (1 + np.sign(kth) * 1e-12))
            assert set(need) <= set(found) and len(found) >= 7
            assert all(np.isclose(found[j], true[i, j], rtol=1e-12, atol=2e-6) for j in found)
