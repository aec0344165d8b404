"""Token counts by a public tokenizer."""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKENIZER_DIR = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
#: One vocabulary in the files of two libraries: the first is counted with, the second stands in where the first gives up.
RANKS_FILE, TOKENIZER_FILE = "byte_bpe_50k.tiktoken", "byte_bpe_50k.json"
# fixed value: how the vocabulary's texts are cut into words before their bytes are merged
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The first library's expressions give up on very long runs of white space.
_LONG_GAP = re.compile(r"\s{10000}")

_loaded: dict[str, object] = {}


def _encoding(folder: str):
    path = f"{folder}/{RANKS_FILE}"
    if path not in _loaded:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _loaded[path] = tiktoken.Encoding("vocabulary", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def _tokenizer(folder: str):
    path = f"{folder}/{TOKENIZER_FILE}"
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(path)
        made.encode_special_tokens = True
        made.no_truncation()
        _loaded[path] = made
    return _loaded[path]


def count_tokens(text: str, folder: str = TOKENIZER_DIR) -> int:
    """Tokens of the whole text; the strings of special tokens are ordinary text."""
    if not _LONG_GAP.search(text):
        return len(_encoding(folder).encode_ordinary(text))
    return len(_tokenizer(folder).encode(text, add_special_tokens=False))


def token_count(text: Column, folder: str = TOKENIZER_DIR) -> Column:
    """Tokens of the whole text; null and empty texts have 0. The folder with the vocabulary must exist on every executor."""

    @F.pandas_udf("bigint")
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series([count_tokens(t, folder) if t else 0 for t in texts], dtype="int64")

    return count(text)


def spread(df: DataFrame) -> DataFrame:
    """Over all cores, before costly Python work, if the table is too small to fill them.

    A table with a full-size split for every core stays as it is read: its
    splits are many and even. A smaller one sits in few files or row groups and
    is dealt anew, never to fewer partitions than it had.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) >= cores * split:
        return df
    return df.repartition(max(cores, int(spark.conf.get("spark.sql.shuffle.partitions")), df.rdd.getNumPartitions()))
