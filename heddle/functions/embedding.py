"""Embedders: a text Column becomes a vector Column, in the role of a document or of a query."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import hash_embedding_column


@dataclass(frozen=True)
class Preset:
    """What a model expects around its texts and how its token vectors become one."""

    dim: int
    pooling: str | None
    query_prefix: str = ""
    document_prefix: str = ""


# fixed values: the models' dimensions, poolings and prefixes
PRESETS = {
    "minilm": Preset(384, "mean"),
    "bge": Preset(768, "cls", query_prefix="Represent this sentence for searching relevant passages: "),
    "e5-small": Preset(384, "mean", query_prefix="query: ", document_prefix="passage: "),
    "clip": Preset(512, None),
}


class EmbeddingError(ValueError):
    """An embedder that does not fit."""


def preset(name: str) -> Preset:
    found = PRESETS.get((name or "").strip().lower())
    if found is None:
        raise EmbeddingError(f"no preset {name!r}; there are {', '.join(sorted(PRESETS))}")
    return found


class Embedder:
    """Roles and the dimension check; subclasses turn prefixed texts into vectors."""

    def __init__(self, dim: int, query_prefix: str = "", document_prefix: str = ""):
        self.dim, self.query_prefix, self.document_prefix = dim, query_prefix, document_prefix

    def vectors(self, text: Column) -> Column:
        raise NotImplementedError

    def documents(self, text: Column) -> Column:
        return self.vectors(F.concat(F.lit(self.document_prefix), text) if self.document_prefix else text)

    def queries(self, text: Column) -> Column:
        return self.vectors(F.concat(F.lit(self.query_prefix), text) if self.query_prefix else text)

    def check(self, dim: int) -> None:
        if self.dim != dim:
            raise EmbeddingError(f"the embedder has {self.dim} dimensions, the collection {dim}")


class HashEmbedder(Embedder):
    """Deterministic vectors from hashes, inside the JVM; needs no model."""

    def vectors(self, text: Column) -> Column:
        return hash_embedding_column(text, self.dim).cast("array<float>")


class BatchEmbedder(Embedder):
    """Any function from a list of texts to a matrix, such as a model session, called per Arrow batch.

    ``load`` makes the function once per Python worker, so that models are not
    sent with the plan. Rows of another dimension or with non-finite numbers
    stop the query; null texts have null vectors.
    """

    def __init__(self, load: Callable[[], Callable[[list[str]], np.ndarray]], dim: int, query_prefix: str = "", document_prefix: str = "", normalize: bool = True):
        super().__init__(dim, query_prefix, document_prefix)
        self.load, self.normalize = load, normalize

    @classmethod
    def of_preset(cls, name: str, load: Callable[[], Callable[[list[str]], np.ndarray]]) -> BatchEmbedder:
        p = preset(name)
        return cls(load, p.dim, p.query_prefix, p.document_prefix)

    def vectors(self, text: Column) -> Column:
        load, dim, normalize = self.load, self.dim, self.normalize

        def embed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            run = load()
            for texts in parts:
                there = texts.notna().to_numpy()
                out = np.full(len(texts), None, object)
                if there.any():
                    rows = np.asarray(run(texts[there].tolist()), np.float32)
                    if rows.shape != (there.sum(), dim):
                        raise EmbeddingError(f"the model returned {rows.shape}, wanted {(int(there.sum()), dim)}")
                    if not np.isfinite(rows).all():
                        raise EmbeddingError("the model returned numbers that are not finite")
                    norm = np.linalg.norm(rows, axis=1, keepdims=True)
                    rows = np.divide(rows, norm, out=np.zeros_like(rows), where=norm > 0) if normalize else rows
                    out[np.flatnonzero(there)] = list(rows)
                yield pd.Series(out)

        return F.pandas_udf(embed, "array<float>")(text)


def pool(tokens: np.ndarray, mask: np.ndarray | None = None, how: str = "mean") -> np.ndarray:
    """One vector per text from token vectors (texts x tokens x dim): the first token's (``cls``) or the mean over the mask.

    Output that is pooled already (texts x dim) stays as it is; a text without
    any token has a zero vector.
    """
    tokens = np.asarray(tokens, np.float32)
    if tokens.ndim == 2:
        return tokens
    if tokens.ndim != 3:
        raise EmbeddingError("token vectors have three dimensions")
    if how == "cls":
        return tokens[:, 0]
    if how != "mean" or mask is None or mask.shape != tokens.shape[:2]:
        raise EmbeddingError("mean pooling needs a mask of texts x tokens; the other way is cls")
    weight = mask[:, :, None].astype(np.float32)
    return (tokens * weight).sum(1) / np.maximum(weight.sum(1), 1e-9)


def unpadded(tokens: np.ndarray, mask: np.ndarray) -> list[np.ndarray]:
    """Late-interaction patches of each text: its own token vectors, each of unit length."""
    out = []
    for rows, own in zip(np.asarray(tokens, np.float32), mask.astype(bool)):
        kept = rows[own]
        norm = np.linalg.norm(kept, axis=1, keepdims=True)
        out.append(np.divide(kept, norm, out=np.zeros_like(kept), where=norm > 0))
    return out
