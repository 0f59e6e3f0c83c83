"""Sizes of texts in tokens of a public byte-pair tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

LONG = 200_000


def default_vocabulary() -> str:
    """Where the installed vocabulary lies; any other rank file may be named instead."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=2)
def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str) -> Iterator[str]:
    """A very long text cut before single blanks between words, where no token can reach across."""
    at = 0
    while len(text) - at > LONG:
        cut = at + LONG
        while cut < len(text) and not (text[cut] == " " and text[cut - 1].isalnum() and text[cut + 1 : cut + 2].isalnum()):
            cut += 1
        yield text[at:cut]
        at = cut
    yield text[at:]


def count_tokens(text: str | None, path: str) -> int:
    """Number of tokens of the whole text; 0 for null and empty."""
    if not text:
        return 0
    encode = _encoding(path).encode_ordinary
    return len(encode(text)) if len(text) <= LONG else sum(len(encode(p)) for p in pieces(text))


def token_count(text: Column, vocabulary: str | None = None) -> Column:
    path = vocabulary or default_vocabulary()

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([count_tokens(t, path) for t in texts], dtype="int64")

    return count(text)
