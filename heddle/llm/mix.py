"""Mixing sources to target weights.

A classifier, fitted on a bounded sample of labelled documents, predicts for
every document how likely each source is. The recorded label, where there is
one, counts as evidence that is wrong with a small probability, so labels and
texts together give the document's soft membership. Projected-gradient least
squares then finds a nonnegative rate for every document such that the expected
tokens of each source match the targets, no rate exceeding its cap, and rates
become whole repeats by error diffusion, so that the realised tokens follow the
rates closely.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.binding import let
from ..sources.tables import cut_lineage
from .tokens import token_count

#: Labelled documents that the classifier is fitted on, hashed word features, and most sources in a mixture.
FIT_ROWS, FEATURES, MAX_TARGETS = 20_000, 1 << 14, 200
#: Probability that a recorded label is wrong, and decimals kept of a membership.
LABEL_DOUBT, DIGITS = 0.002, 3
ROUNDS, PRECISION = 30, 1e-5
SHARD_DOCS = 40_000

#: Stands for all sources without a target; no source is spelled with a space once it has been normalised.
OTHER = "other sources"

ROUNDED = "doc_id bigint, source string, tokens bigint, rate double, repeats int"


def source_key(source: Column) -> Column:
    """One spelling: lower case, letters and digits only; null if nothing is left."""
    return F.nullif(F.regexp_replace(F.lower(source), r"[^\p{L}\p{N}]", ""), F.lit(""))


def _targets(targets: DataFrame) -> list[tuple[str, str, float, int]]:
    """(key, name, share, cap) per source; shares of equal keys add up, the smallest cap counts."""
    rows = targets.select(source_key(F.col("source")).alias("k"), "source", "target_share", "max_repeats").limit(MAX_TARGETS + 1).collect()
    if len(rows) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} targets")
    merged: dict[str, tuple[str, float, int]] = {}
    for r in sorted((r for r in rows if r["k"] and (r["target_share"] or 0) > 0), key=lambda r: r["source"]):
        name, share, cap = merged.get(r["k"], (r["source"], 0.0, 1 << 30))
        merged[r["k"]] = (name, share + r["target_share"], min(cap, r["max_repeats"] or 0))
    return [(k, *v) for k, v in sorted(merged.items())]


def fit_classifier(labelled: DataFrame, rows: int = FIT_ROWS):
    """Multinomial logistic regression on hashed words of (text, label), fitted on about ``rows`` rows chosen by hash."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF, IDF, Normalizer, RegexTokenizer, StringIndexer

    n = labelled.count()
    share = int(min(1.0, rows / max(n, 1)) * (1 << 30))
    sample = labelled.select("text", "label").filter(F.pmod(F.xxhash64("text", "label"), F.lit(1 << 30)) <= share)
    stages = [
        RegexTokenizer(inputCol="text", outputCol="words", pattern=r"[\p{L}\p{N}_]+", gaps=False),
        HashingTF(inputCol="words", outputCol="tf", numFeatures=FEATURES),
        IDF(inputCol="tf", outputCol="tfidf", minDocFreq=2),
        Normalizer(inputCol="tfidf", outputCol="features"),
        StringIndexer(inputCol="label", outputCol="index", stringOrderType="alphabetAsc"),
        LogisticRegression(featuresCol="features", labelCol="index", maxIter=12, regParam=0.5, family="multinomial"),
    ]
    return Pipeline(stages=stages).fit(cut_lineage(sample, "labelled"))


def posteriors(model, rows: DataFrame, names: list[str]) -> DataFrame:
    """Adds ``membership``, the predicted probability of each of ``names``."""
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml import PipelineModel

    classes = list(model.stages[4].labels)
    steps = PipelineModel([s for i, s in enumerate(model.stages) if i != 4])
    p = vector_to_array("probability")
    pick = let(p, lambda q: F.array(*[q[classes.index(n)] if n in classes else F.lit(0.0) for n in names]))
    return steps.transform(rows).withColumn("membership", pick).drop("words", "tf", "tfidf", "features", "rawPrediction", "probability", "prediction")


def with_label(membership: Column, label: Column, shares: dict[str, float], doubt: float) -> Column:
    """The membership once the recorded label is known, by Bayes' rule.

    A label is wrong with probability ``doubt`` and then as likely as it is
    common (``shares``: part of the labels per source, in the order of the
    membership). Without a label, or with one that no source has, the membership
    stays as it is.
    """
    wrong = F.element_at(F.create_map(*[F.lit(x) for n, share in shares.items() for x in (n, doubt * share)]), label)
    odds = [F.when(label == n, F.lit(1 - doubt) + wrong).otherwise(F.coalesce(wrong, F.lit(1.0))) for n in shares]
    unit = lambda w, m: let(F.aggregate(w, F.lit(0.0), lambda a, x: a + x), lambda total: F.when(total > 0, F.transform(w, lambda x: x / total)).otherwise(m))
    return let(membership, lambda m: let(F.zip_with(m, F.array(*odds), lambda x, o: x * o), lambda w: unit(w, m)))


def rates_at(membership: np.ndarray, caps: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """The rate of each document after gradient steps that add up to ``steps`` (one number per source), projected onto [0, cap]."""
    return np.clip(np.minimum(1.0, caps) - membership @ steps, 0.0, caps)


def _sums(groups: DataFrame, k: int, weigh) -> np.ndarray:
    """Sums over all groups of ``weigh(membership, caps, tokens)``, an array of k numbers or of k rows of k.

    Every task returns one row, so the driver adds up as many rows as there are partitions.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for part in parts:
            if len(part):
                found = weigh(np.array(part["membership"].tolist()), part["cap"].to_numpy(), part["tokens"].to_numpy())
                total = found if total is None else total + found
        if total is not None:
            yield pd.DataFrame({"sums": [np.ravel(total).tolist()]})

    rows = groups.mapInPandas(run, "sums array<double>").collect()
    return np.sum([r[0] for r in rows], axis=0) if rows else np.zeros(0)


def fit_rates(groups: DataFrame, shares: list[float], rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """The summed gradient steps of the least squares, and the tokens the mixture aims at.

    ``groups``: membership, cap, tokens; ``shares`` has a number for each
    component of a membership, 0 for what should not be in the mixture. The
    objective is the sum over sources of (expected tokens - share x total)^2.
    The gradient is scaled by the second derivatives over the documents whose
    rate can still move the way the source must go (down if it has too much, up
    if too little), so steps do not overshoot and few rounds are needed. As the
    steps only add up, a round needs one pass and no memory of earlier rounds.
    The total is the largest at which no reachable source needs more than its
    cap. Sources without any expected tokens cannot be reached.
    """
    k = len(shares)
    goal = np.array(shares)

    def at_caps(p: np.ndarray, caps: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        each = p * (tokens * caps)[:, None]
        return np.vstack([each.sum(0), (each * (p >= p.max(1, keepdims=True))).sum(0)])

    found = _sums(groups, k, at_caps)
    at_cap, own = found.reshape(2, k) if len(found) else np.zeros((2, k))
    reachable = (at_cap > 0) & (goal > 0)
    if not reachable.any():
        return np.zeros(k), 0.0
    # what documents of other sources add by a small chance cannot be counted on
    sure = np.where(own > 0, own, at_cap)
    total = float((sure[reachable] / goal[reachable]).min())
    steps = np.where(goal <= 0, 1.0, 0.0)  # a document starts with the part of it that may be in the mixture at all
    best, least = steps, np.inf
    for _ in range(rounds):

        def weigh(p: np.ndarray, caps: np.ndarray, tokens: np.ndarray, now=steps) -> np.ndarray:
            rates = rates_at(p, caps, now)
            second = [(p * (tokens * can)[:, None]).T @ p for can in (rates > 0, rates < caps)]
            return np.vstack([(tokens * rates) @ p, *second])

        found = _sums(groups, k, weigh).reshape(2 * k + 1, k)
        miss = np.where(reachable, found[0] - goal * total, 0.0)
        if np.abs(miss).max() < least:
            best, least = steps, np.abs(miss).max()
        if least <= PRECISION * total:
            break
        second = np.where(miss[:, None] > 0, found[1 : k + 1], found[k + 1 :]) + np.diag(1e-6 * np.maximum(at_cap, 1.0))
        move = np.zeros(k)
        move[reachable] = np.linalg.solve(second[np.ix_(reachable, reachable)], miss[reachable])
        steps = steps + np.clip(move, -1.0, 1.0)
    return best, total


def diffuse(tokens: np.ndarray, rates: np.ndarray, caps: np.ndarray) -> np.ndarray:
    """Whole repeats, largest documents first, each rounded so that the tokens so far stay nearest to those wanted."""
    whole = np.floor(rates + 1e-9).astype(np.int64)
    out, debt = whole.tolist(), 0.0
    part = np.maximum(rates - whole, 0.0).tolist()
    for i, (n, p, cap) in enumerate(zip(tokens.tolist(), part, caps.tolist())):
        debt += n * p
        if p > 0 and out[i] < cap and n > 0 and debt >= n / 2:
            out[i] += 1
            debt -= n
    return np.array(out, np.int64)


def _round_shard(steps: np.ndarray):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["tokens", "doc_id"], ascending=[False, True], kind="stable")
        caps = part["cap"].to_numpy()
        rates = np.round(rates_at(np.array(part["membership"].tolist()), caps, steps), 9)
        kept = part.assign(rate=rates, repeats=diffuse(part["tokens"].to_numpy(), rates, caps).astype("int32"))
        return kept.loc[kept["repeats"] > 0, ["doc_id", "source", "tokens", "rate", "repeats"]]

    return run


def memberships(documents: DataFrame, keys: list[str], fit_rows: int = FIT_ROWS, doubt: float = LABEL_DOUBT, wanted: Column | None = None) -> DataFrame:
    """doc_id, k (recorded source or null), tokens, membership of every document.

    ``membership`` has one number for each of ``keys`` and a last one for all
    other sources; they add up to 1. ``wanted`` restricts the documents that are
    judged, not those that the classifier learns from. With labelled rows of fewer than two
    sources there is nothing to learn: a label then stands for itself and
    documents without one belong to no source.
    """
    columns = [F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), source_key(F.col("source")).alias("k")]
    rows = documents.select(*columns)
    labelled = rows.filter(F.col("k").isNotNull() & (F.length("text") > 0))
    labelled = labelled.select("text", F.when(F.col("k").isin(keys), F.col("k")).otherwise(OTHER).alias("label"))  # sources without a target are one class
    kinds = {r[0]: r[1] for r in labelled.groupBy("label").count().collect()}  # at most MAX_TARGETS + 1 rows
    if wanted is not None:
        rows = documents.filter(wanted).select(*columns)
    sized = rows.withColumn("tokens", token_count(F.col("text")))  # no filter on it: it would be counted once for the filter and once more
    if len(kinds) < 2:
        known = F.array(*[F.coalesce(F.col("k") == k, F.lit(False)).cast("double") for k in keys])
        found = sized.withColumn("membership", known)
    else:
        model = fit_classifier(labelled, fit_rows)
        names = [*keys, OTHER]
        label = F.when(F.col("k").isNull() | F.col("k").isin(keys), F.col("k")).otherwise(F.lit(OTHER))
        common = {n: kinds.get(n, 0) / sum(kinds.values()) for n in names}
        found = posteriors(model, sized, names).withColumn("membership", with_label(F.col("membership"), label, common, doubt))
    rest = lambda r: F.greatest(F.lit(0.0), F.round(1 - F.aggregate(r, F.lit(0.0), lambda a, x: a + x), DIGITS))
    rounded = let(F.transform(F.slice("membership", 1, len(keys)), lambda x: F.round(x, DIGITS)), lambda r: F.concat(r, F.array(rest(r))))
    return found.select("doc_id", "k", "tokens", rounded.alias("membership"))


def mixture(documents: DataFrame, targets: DataFrame, fit_rows: int = FIT_ROWS, doubt: float = LABEL_DOUBT) -> DataFrame:
    """How often each document is used: doc_id, source, tokens, rate, repeats >= 1.

    ``documents``: doc_id, text, source; ``targets``: source, target_share,
    max_repeats (at most ``MAX_TARGETS`` rows). Sources match whatever their
    case, spaces and hyphens. Every document counts for each target by its
    membership, see ``memberships``; it is listed, and its cap is that of, the
    recorded source, or where none is recorded the likeliest target. Documents
    recorded under a source without a target are not used; those that merely
    seem to belong elsewhere are used as far as the least squares let them.
    Documents without tokens, targets with null or nonpositive share and caps of
    0 or null contribute nothing. Repeated rows are documents of their own.
    """
    wanted = _targets(targets)
    spark = documents.sparkSession
    if not wanted:
        return spark.createDataFrame([], ROUNDED)
    keys, names, shares, caps = (list(x) for x in zip(*wanted))
    cap_of = F.create_map(*[F.lit(x) for k, c in zip(keys, caps) for x in (k, float(c))])
    likeliest = F.element_at(F.array(*[F.lit(k) for k in keys]), F.array_position(F.slice("membership", 1, len(keys)), F.array_max(F.slice("membership", 1, len(keys)))).cast("int"))
    some = F.exists(F.slice("membership", 1, len(keys)), lambda x: x > 0)
    recorded = source_key(F.col("source"))
    judged = cut_lineage(memberships(documents, keys, fit_rows, doubt, recorded.isNull() | recorded.isin(keys)), "members")
    members = judged.withColumn("k", F.coalesce("k", F.when(some, likeliest))).filter(F.col("k").isNotNull() & (F.col("tokens") > 0)).withColumn("cap", F.element_at(cap_of, F.col("k")))
    groups = cut_lineage(members.groupBy("membership", "cap").agg(F.sum("tokens").alias("tokens")), "groups")
    steps, total = fit_rates(groups, [*shares, 0.0])
    if not total:
        return spark.createDataFrame([], ROUNDED)
    counts = {r[0]: max(1, math.ceil(r[1] / SHARD_DOCS)) for r in members.groupBy("k").count().collect()}  # at most MAX_TARGETS rows
    shards = F.create_map(*[F.lit(x) for kv in counts.items() for x in kv])
    name_of = F.create_map(*[F.lit(x) for kv in zip(keys, names) for x in kv])
    return (
        members.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.element_at(shards, F.col("k"))).cast("int"))
        .withColumn("source", F.element_at(name_of, F.col("k")))
        .groupBy("k", "shard")
        .applyInPandas(_round_shard(steps), ROUNDED)
    )


def mixture_report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target: the share wanted and the share of all used tokens reached, with documents, uses and tokens."""
    used = mixed.groupBy("source").agg(
        F.count(F.lit(1)).alias("documents"), F.sum("repeats").alias("uses"), F.max("repeats").alias("most_repeats"), F.sum(F.col("tokens") * F.col("repeats")).alias("used_tokens")
    )
    whole = Window.partitionBy()
    zero = F.lit(0).cast("bigint")
    rows = targets.join(F.broadcast(used), "source", "left").withColumns(
        {c: F.coalesce(c, zero) for c in ("documents", "uses", "most_repeats", "used_tokens")}
    )
    total = F.sum("used_tokens").over(whole)
    return rows.select("source", "target_share", "max_repeats", "documents", "uses", "most_repeats", "used_tokens", F.when(total > 0, F.col("used_tokens") / total).otherwise(0.0).alias("actual_share"))
