"""Text identity: tokens, chunks, hashes and ids as Columns."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import cut_lineage
from .binding import let
from .vectors import l2_normalize

# fixed values: the token pattern, the chunk length, the format of chunk ids below and the bytes of the hash embedding
TOKEN = r"[0-9a-z]+(?:[-./][0-9a-z]+)*"
CHUNK_LIMIT = 900
# fixed values: the characters with the Unicode property White_Space, as a Java character class
WHITE_SPACE = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def tokenize(text: Column) -> Column:
    """Lower-cased tokens in order, repeats kept; null text has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({TOKEN})"), F.lit(1))


def trim_unicode(text: Column) -> Column:
    # the look-behind lets a match begin at the start of a run only, so long runs inside a text stay linear
    return F.regexp_replace(F.regexp_replace(text, rf"\A{WHITE_SPACE}+", ""), rf"(?<!{WHITE_SPACE}){WHITE_SPACE}+\z", "")


def chunk_text(text: Column, limit: int = CHUNK_LIMIT) -> Column:
    """Windows of ``limit`` code points of the trimmed text; empty for blank or null text."""
    if limit < 1:
        raise ValueError("the limit must be positive")

    # one pass over the text; substring() would count code points from the start for every window
    return F.regexp_extract_all(trim_unicode(F.coalesce(text, F.lit(""))), F.lit(f"(?s)(.{{1,{limit}}})"), F.lit(1))


def sha256_text(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def normalized_chunk_hash(text: Column) -> Column:
    """SHA-256 of the words joined by single spaces."""
    return sha256_text(F.regexp_replace(trim_unicode(text), f"{WHITE_SPACE}+", " "))


def chunk_id(document_id: Column, chunk_hash: Column, occurrence: Column) -> Column:
    return F.format_string("%s:%s:%04d", document_id, F.substring(chunk_hash, 1, 12), occurrence)


def stable_id(text: Column) -> Column:
    """First 8 bytes of the SHA-256, little-endian, never 0; decimal(20,0) since it is unsigned."""
    digest = sha256_text(text)
    swapped = F.concat(*[F.substring(digest, 15 - 2 * i, 2) for i in range(8)])
    value = F.conv(swapped, 16, 10).cast("decimal(20,0)")
    return F.when(value == 0, F.lit(1).cast("decimal(20,0)")).otherwise(value)


def repair_collisions(ids: DataFrame, order: str, stable: str = "stable_id") -> DataFrame:
    """Distinct stable ids: of rows with the same one the first by ``order`` keeps it, the others move to the next free number.

    The result is that of numbering the rows one after the other. Numbers wrap
    from 2^64 - 1 to 1, as 0 is none. Collisions of 64-bit hashes are rare, so
    usually one pass finds nothing to do; every further pass moves the rows that
    had to yield by one.
    """
    top, kind = (1 << 64) - 1, "decimal(20,0)"
    rows = ids
    first = Window.partitionBy(stable).orderBy(order)
    while True:
        placed = cut_lineage(rows.withColumn("__place", F.row_number().over(first)), "stable")
        if placed.filter("__place > 1").isEmpty():
            return placed.drop("__place")
        moved = F.when(F.col(stable) == F.lit(str(top)).cast(kind), F.lit(1).cast(kind)).otherwise((F.col(stable) + 1).cast(kind))
        rows = placed.withColumn(stable, F.when(F.col("__place") > 1, moved).otherwise(F.col(stable))).drop("__place")


def edge_id(src: Column, relation: Column, dst: Column) -> Column:
    return F.concat_ws(":", src, relation, dst)


def id_fingerprint(ident: Column, length: int = 12) -> Column:
    """A short hash that stands for an id in reports."""
    return F.substring(sha256_text(ident), 1, length)


def redact_dsn(dsn: Column) -> Column:
    """A connection string without user and password."""
    return F.regexp_replace(F.regexp_replace(dsn, r"://[^/@]*@", "://***@"), r"(?i)(password|user)=[^\s&;]*", "$1=***")


def hash_embedding(text: str, dim: int) -> list[float]:
    """A deterministic unit vector from SHA-256 bytes; for tests and as the default embedder."""
    raw = b""
    counter = 0
    while len(raw) < dim:
        raw += hashlib.sha256(f"{counter}:{text}".encode()).digest()
        counter += 1
    values = [(b - 127.5) / 127.5 for b in raw[:dim]]
    norm = sum(v * v for v in values) ** 0.5
    return [v / norm for v in values]


def hash_embedding_column(text: Column, dim: int) -> Column:
    """``hash_embedding`` inside the JVM."""
    digest = lambda t: F.concat(*[F.sha2(F.concat(F.lit(f"{i}:"), t), 256) for i in range(-(-dim // 32))])
    byte = lambda d, i: F.conv(F.substring(d, i * 2 + 1, F.lit(2)), 16, 10).cast("double")
    values = let(let(text, digest), lambda d: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: (byte(d, i) - 127.5) / 127.5))
    return let(values, lambda v: l2_normalize(v))
