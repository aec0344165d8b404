import numpy as np
import pytest

from heddle.llm import mix
from heddle.llm.tokens import token_count

from ..conftest import rows

DOC = "doc_id bigint, text string, source string, tokens bigint, membership string"
TARGET = "source string, target_share double, max_repeats int"


def documents(spark):
    """Two talkative sources with words of their own, a small one, one without a target, and unlabelled texts."""
    out = []
    for i in range(600):
        kind = ("Big-Source", "other_kind", "big source ", None)[i % 4] if i % 20 else "tiny"
        own = {"tiny": "violin cello opera", "other_kind": "tennis match court"}.get(kind, "engine wheel brake")
        out.append((i, f"{own} number {i} " * (1 + i % 7), kind, 0, "clash"))
    out += [(1000, None, "tiny", 0, "c"), (1001, "", None, 0, "c"), (1002, "word " * 3000, "elsewhere", 0, "c")]
    return spark.createDataFrame(out, DOC)


def test_shares_are_reached(spark):
    targets = spark.createDataFrame([("big-source", 0.5, 1), ("other-kind", 0.3, 2), ("tiny", 0.2, 5), ("absent", 0.0, 3)], TARGET)
    got = mix.mixture(documents(spark), targets)
    used = got.collect()
    assert all(1 <= r["repeats"] <= {"big-source": 1, "other-kind": 2, "tiny": 5}[r["source"]] for r in used)
    assert 1002 not in {r["doc_id"] for r in used} and 1000 not in {r["doc_id"] for r in used}
    report = {r["source"]: r for r in mix.mixture_report(got, targets).collect()}
    for source, share in (("big-source", 0.5), ("other-kind", 0.3), ("tiny", 0.2)):
        assert abs(report[source]["actual_share"] - share) < 0.02, report
    assert report["absent"]["actual_share"] == 0
    unlabelled = {r["doc_id"]: r["source"] for r in used if r["doc_id"] % 4 == 3 and r["doc_id"] % 20 and r["doc_id"] < 600}
    assert set(unlabelled.values()) == {"big-source"}  # by their words


def test_caps_limit_the_total(spark):
    """A source too small for its share limits the whole mixture and is used up to its cap."""
    docs = spark.createDataFrame([(i, "a b c d e f g h", "small" if i < 10 else "large", 0, "c") for i in range(1000)], DOC)
    targets = spark.createDataFrame([("small", 0.5, 3), ("large", 0.5, 1)], TARGET)
    report = {r["source"]: r for r in mix.mixture_report(mix.mixture(docs, targets), targets).collect()}
    assert report["small"]["uses"] == 30 and report["large"]["uses"] == 30
    assert report["small"]["actual_share"] == pytest.approx(0.5)


def test_nothing_to_mix(spark):
    docs = documents(spark)
    targets = spark.createDataFrame([("big-source", 0.5, 1)], TARGET)
    assert mix.mixture(docs, targets.limit(0)).count() == 0
    assert mix.mixture(docs.limit(0), targets).count() == 0
    assert mix.mixture(docs, spark.createDataFrame([("big-source", 0.5, None), (None, 0.5, 1)], TARGET)).count() == 0


def test_held_out_accuracy(spark):
    from pyspark.sql import functions as F

    labelled = documents(spark).filter("source is not null and length(text) > 0").withColumn("label", mix.source_key(F.col("source"))).filter("label <> 'elsewhere'")
    model = mix.fit_classifier(labelled.filter("doc_id % 3 <> 0").select("text", "label"))
    names = ["bigsource", "otherkind", "tiny"]
    held = mix.posteriors(model, labelled.filter("doc_id % 3 = 0"), names).collect()
    right = [names[int(np.argmax(r["membership"]))] == r["label"] for r in held]
    assert np.mean(right) > 0.95 and all(abs(sum(r["membership"]) - 1) < 1e-6 for r in held)


def test_diffusion_follows_the_rates():
    rng = np.random.default_rng(1)
    tokens = np.sort(rng.integers(1, 500, 5000))[::-1].astype(float)
    rates = np.full(5000, 1.37)
    repeats = mix.diffuse(tokens, rates, np.full(5000, 2.0))
    assert set(repeats.tolist()) <= {1, 2}
    assert abs((tokens * repeats).sum() - (tokens * rates).sum()) <= 1


def test_source_keys(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(" Run-Book ",), ("run_book",), ("RUN BOOK",), ("--",), (None,)], "s string")
    assert [r[0] for r in df.select(mix.source_key(F.col("s"))).collect()] == ["runbook"] * 3 + [None, None]


def test_token_counts(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, "hello world"), (2, ""), (3, None), (4, "<|endoftext|>"), (5, "x" * 20000)], "i int, t string")
    got = dict(rows(df.select("i", token_count(F.col("t")).alias("n"))))
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 1 and got[5] > 100


def test_labels_and_texts_are_weighed(spark):
    from pyspark.sql import functions as F

    shares = {"a": 0.8, "b": 0.1, "c": 0.1}
    cases = [([0.2, 0.3, 0.5], "b"), ([0.999998, 0.000001, 0.000001], "b"), ([0.2, 0.3, 0.5], None), ([0.2, 0.3, 0.5], "unknown"), ([0.0, 0.0, 0.0], "a")]
    df = spark.createDataFrame([(i, m, k) for i, (m, k) in enumerate(cases)], "i int, m array<double>, k string")
    got = {r["i"]: r["w"] for r in df.select("i", mix.with_label(F.col("m"), F.col("k"), shares, 0.01).alias("w")).collect()}
    for i, (m, k) in enumerate(cases[:2]):
        odds = np.array([0.99 + 0.01 * shares[k] if n == k else 0.01 * shares[k] for n in shares]) * m
        assert got[i] == pytest.approx((odds / odds.sum()).tolist())
    assert got[0][1] > 0.99 and got[1][0] > 0.9  # a plain text outweighs its label
    assert got[2] == got[3] == [0.2, 0.3, 0.5] and got[4] == [0.0] * 3


def test_every_document_is_judged(spark):
    docs = documents(spark)
    got = mix.memberships(docs, ["bigsource", "otherkind", "tiny"]).collect()
    assert len(got) == docs.count() and all(len(r["membership"]) == 4 and abs(sum(r["membership"]) - 1) < 2e-3 for r in got)
    soft = [r for r in got if r["k"] is None and r["tokens"] > 0]
    assert soft and all(r["membership"][0] > 0.5 for r in soft)
    one = mix.memberships(docs.filter("source = 'tiny' or source is null"), ["tiny"])  # nothing to tell apart
    assert {tuple(r["membership"]) for r in one.filter("k = 'tiny'").collect()} == {(1.0, 0.0)}


def test_rates_meet_the_targets_with_soft_memberships(spark):
    rng = np.random.default_rng(2)
    p = rng.dirichlet([0.3] * 4, 400).round(3)
    caps, tokens = rng.choice([1.0, 2.0, 4.0], 400), rng.integers(1, 900, 400)
    groups = spark.createDataFrame([(m.tolist(), float(c), int(t)) for m, c, t in zip(p, caps, tokens)], "membership array<double>, cap double, tokens bigint")
    shares = [0.5, 0.3, 0.2, 0.0]
    steps, total = mix.fit_rates(groups, shares)
    rates = mix.rates_at(p, caps, steps)
    assert ((rates >= 0) & (rates <= caps)).all()
    reached = (rates * tokens) @ p
    assert np.abs(reached[:3] - total * np.array(shares[:3])).max() < 1e-3 * total
    assert mix.fit_rates(groups.limit(0), shares)[1] == 0.0 and mix.fit_rates(groups, [0.0] * 4)[1] == 0.0


def test_the_fitted_sample_is_bounded(spark, monkeypatch):
    from pyspark.sql import functions as F

    seen = []
    cut = mix.cut_lineage
    monkeypatch.setattr(mix, "cut_lineage", lambda df, label: seen.append((label, cut(df, label))) or seen[-1][1])
    labelled = documents(spark).filter("source is not null and length(text) > 0").select(F.concat_ws(" ", "text", "doc_id").alias("text"), F.col("source").alias("label"))
    mix.fit_classifier(labelled, 120)
    assert 60 < seen[0][1].count() < 200 < labelled.count()
