"""Sizes of texts in tokens of a given byte-level BPE vocabulary."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Default place of the vocabulary file, one "base64-token rank" pair a line.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the published split pattern that belongs to this vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoding(path: str, pattern: str = PATTERN):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def n_tokens(text: str | None, path: str = VOCABULARY) -> int:
    """Tokens of a text, 0 for NULL; strings of special tokens are ordinary text."""
    return len(encoding(path).encode_ordinary(text)) if text else 0


def with_tokens(df: DataFrame, text: str = "text", out: str = "n_tokens", vocabulary: str = VOCABULARY, keep: list[str] | None = None) -> DataFrame:
    """``df`` (its columns ``keep``) with the number of tokens of the whole text.

    Whole texts are tokenised, one Arrow batch at a time. Identical texts that
    stand in one batch are tokenised once.
    """
    keep = [c for c in df.columns if c != out] if keep is None else keep
    schema = df.select(*(F.col(f"`{c}`") for c in keep)).schema

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            seen: dict[str, int] = {}
            sizes = []
            for t in b["__text"]:
                if t is not None and t not in seen:
                    seen[t] = n_tokens(t, vocabulary)
                sizes.append(seen[t] if t is not None else 0)
            yield b[keep].assign(**{out: sizes})

    source = df.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text}`").alias("__text"))
    return source.mapInPandas(count, schema.add(out, "long"))
