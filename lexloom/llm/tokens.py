"""Sizes in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The byte-level BPE vocabulary for many languages; its place is a parameter of every operator.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: the pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_loaded: dict[str, object] = {}


def encoding(vocabulary: str = VOCABULARY):
    """The tokenizer, loaded once per worker."""
    if vocabulary not in _loaded:
        import tiktoken

        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        _loaded[vocabulary] = tiktoken.Encoding("lexloom", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[vocabulary]


def token_count(text: Column, vocabulary: str = VOCABULARY) -> Column:
    """Tokens of the whole text; 0 for null and empty texts."""

    @F.pandas_udf("int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenizer = encoding(vocabulary)
        for batch in batches:
            yield pd.Series([len(t) for t in tokenizer.encode_ordinary_batch(["" if x is None else x for x in batch], num_threads=1)], dtype="int32")

    return count(text)
