"""Sizes of texts in tokens of a public tokenizer, whose files are named by a path."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Folder of the vocabulary files; a parameter of every operator that counts tokens.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: how the byte-level vocabulary cuts a text into words before merging.
WORDS = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoder(folder: str = TOKENIZERS):
    """Encoder of the vocabulary, read once per process."""
    import tiktoken

    with open(f"{folder}/{VOCABULARY}", "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("byte_bpe", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})


def token_count(text: Column, folder: str = TOKENIZERS) -> Column:
    """Number of tokens as a long; 0 for an empty text, null for null. Strings of special tokens are ordinary text."""

    @F.pandas_udf("long")
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder(folder).encode_ordinary
        for batch in texts:
            yield pd.Series([None if t is None else len(encode(t)) for t in batch], dtype="Int64")

    return count(text)
