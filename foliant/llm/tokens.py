"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the ranks are read from, on the driver and every executor; never copied.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the pattern by which the vocabulary's texts are divided before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.cache
def encoding(vocabulary: str = VOCABULARY):
    """The tokenizer, read once per process."""
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_sizes(documents: DataFrame, *keep: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """``keep`` columns and n_tokens of ``text``; rows with null or empty text are left out. Row-local."""
    names = list(keep)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoding(vocabulary).encode_ordinary
        for batch in batches:
            yield batch[names].assign(n_tokens=[len(encode(t)) for t in batch["text"]])

    rows = documents.select(*names, "text").filter(F.col("text").isNotNull() & (F.col("text") != ""))
    schema = ", ".join(f"{c} {t}" for c, t in documents.select(*names).dtypes) + ", n_tokens long"
    return rows.mapInPandas(run, schema)
