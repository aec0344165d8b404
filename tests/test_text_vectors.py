import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from heddle.functions import text as X
from heddle.functions import vectors as V
from heddle.functions.frames import AsOf, encode_ts
from heddle.sources.store import plan_chunks

from .conftest import rows


def column(spark, values, expression, kind="string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], f"v {kind}").select(expression).collect()]


def test_tokens(spark):
    got = column(spark, ["a--b", "Error -E1234- x... y", "/var/log/app.log v1.2.3", "", None, "İKK"], X.tokenize(F.col("v")))
    assert got == [["a", "b"], ["error", "e1234", "x", "y"], ["var/log/app.log", "v1.2.3"], [], [], ["i", "kk"]]


def test_chunks(spark):
    smile = "\U0001f600"
    got = column(spark, ["  abcdefg　", smile * 5, " \n ", None, "ab"], X.chunk_text(F.col("v"), 3))
    assert got == [["abc", "def", "g"], [smile * 3, smile * 2], [], [], ["ab"]]
    with pytest.raises(ValueError):
        X.chunk_text(F.col("v"), 0)


def test_hashes_and_ids(spark):
    (norm,) = column(spark, [" a \n b "], X.normalized_chunk_hash(F.col("v")))
    assert norm == hashlib.sha256(b"a b").hexdigest()
    texts = ["x", "", "é", "chunk:1"]
    got = column(spark, texts, X.stable_id(F.col("v")))
    assert [int(g) for g in got] == [int.from_bytes(hashlib.sha256(t.encode()).digest()[:8], "little") for t in texts]
    df = spark.createDataFrame([("d", "aaabbbaaabbb")], "document_id string, text string")
    ids = rows(plan_chunks(df, 3), "position", "chunk_id")
    a, b = (hashlib.sha256(t).hexdigest()[:12] for t in (b"aaa", b"bbb"))
    assert ids == [(0, f"d:{a}:0000"), (1, f"d:{b}:0000"), (2, f"d:{a}:0001"), (3, f"d:{b}:0001")]


def test_hash_embedding_in_both_forms(spark):
    for dim in (8, 40):
        (got,) = column(spark, ["some text"], X.hash_embedding_column(F.col("v"), dim))
        assert np.allclose(got, X.hash_embedding("some text", dim)) and math.isclose(np.linalg.norm(got), 1)


def test_vector_functions(spark):
    kind = "array<float>"
    assert column(spark, [[3.0, 4.0], [0.0, 0.0], None], V.l2_normalize(F.col("v")), kind) == [[0.6, 0.8], None, None]
    assert column(spark, [[1.0, float("nan")], [1.0], [], None, [1.0, 2.0]], V.valid_vector(F.col("v"), 2), kind) == [False, False, False, False, True]
    (codes,) = column(spark, [[1.0, -0.5, 0.25]], V.int8_encode(F.col("v")), kind)
    assert codes == [127, -64, 32]
    (sha,) = column(spark, [[1.5, -2.0]], V.sha256_f32(F.col("v")), kind)
    assert sha == hashlib.sha256(np.array([1.5, -2], "<f4").tobytes()).hexdigest()
    (back,) = column(spark, [[0.5, 1.25]], V.f16_decode(V.f16_encode(F.col("v"))), kind)
    assert back == [0.5, 1.25]


def test_redaction(spark):
    got = column(spark, ["postgres://me:secret@host/db", "host=h user=me password=s"], X.redact_dsn(F.col("v")))
    assert got == ["postgres://***@host/db", "host=h user=*** password=***"]


FRAME_ROWS = [  # valid_at, invalid_at, created_at, expired_at
    (None, None, 0, None), (10, None, 10, None), (50, None, 5, None), (10, 20, 10, None), (10, 20, 10, 30), (10, 20, 40, None), (None, 5, 0, 5),
]


@pytest.mark.parametrize(
    "frame,want",
    [
        (AsOf.now(), [0, 1, 2]),
        (AsOf.at(15), [0, 1, 3, 4, 5]),
        (AsOf.now_valid(15), [0, 1, 3, 4]),
        (AsOf.at_known(25, 15), [0, 1, 4]),
        (AsOf.at_known(25, 45), [0, 1]),
        (AsOf.all(), list(range(7))),
    ],
)
def test_frames(spark, frame, want):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(FRAME_ROWS)], "i int, valid_at bigint, invalid_at bigint, created_at bigint, expired_at bigint")
    assert [r[0] for r in rows(df.filter(frame.predicate()), "i")] == want


def test_frame_arguments():
    assert AsOf.parse(None, 9).kind == "now" and AsOf.parse("strict", 9).valid == 9 and AsOf.parse("history", 9).kind == "all"
    assert (AsOf.parse((1, 2), 9).valid, AsOf.parse((1, 2), 9).known, AsOf.parse(5, 9).kind) == (1, 2, "at")
    for bad in (True, "x", (1,), 1.5):
        with pytest.raises((TypeError, ValueError)):
            AsOf.parse(bad, 9)


def test_encoded_times_sort(spark):
    values = [None, -(1 << 63), -5, 0, 7, (1 << 63) - 1]
    got = column(spark, values, encode_ts(F.col("v"), "a"), "bigint")
    assert got == sorted(got) and len(set(got)) == len(got)


def test_chunking_is_linear_and_counts_code_points(spark):
    """A text of 300,000 characters, many chunks alike: no row may hold more than its own chunk, nor the time grow with the square."""
    import time

    from heddle.sources.store import plan_chunks

    unit = "ab \U0001f600 " * 180  # 900 code points
    took = {}
    for copies in (50, 400):
        df = spark.createDataFrame([("d", unit * copies + "end")], "document_id string, text string")
        began = time.time()
        got = sorted(plan_chunks(df).select("position", "chunk_id", F.length("text").alias("n")).collect())
        took[copies] = time.time() - began
        assert [r[0] for r in got] == list(range(copies + 1)) and {r[2] for r in got[:-1]} == {900}
        assert [r[1].rsplit(":", 1)[1] for r in got[:-1]] == [f"{i:04d}" for i in range(copies)]
    assert took[400] < 8 * took[50] + 2


def test_long_white_space_inside_a_text(spark):
    df = spark.createDataFrame([("d", "a" + " " * 200_000 + "b"), ("e", " \t" * 1000)], "document_id string, text string")
    from heddle.functions.text import normalized_chunk_hash, sha256_text, trim_unicode

    got = df.select("document_id", F.length(trim_unicode(F.col("text"))).alias("n"), (normalized_chunk_hash(F.col("text")) == sha256_text(F.lit("a b"))).alias("same"))
    assert rows(got) == [("d", 200_002, True), ("e", 0, False)]
