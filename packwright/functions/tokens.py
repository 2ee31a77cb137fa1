"""Exact token counts with a vocabulary file; its path is a parameter."""

from __future__ import annotations

import base64

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The public pattern of the byte-level vocabularies.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


def exact_counter(vocabulary: str, pattern: str = PATTERN):
    """A function from a text column to its number of tokens.

    The vocabulary is read here and travels with the function, so executors need no
    file. Which counter a run used belongs in its ledger: units must not mix.
    """
    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}

    @F.pandas_udf(T.IntegerType())
    def count(texts: pd.Series) -> pd.Series:
        import tiktoken

        encoding = tiktoken.Encoding("exact", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return pd.Series([0 if t is None else len(encoding.encode_ordinary(t)) for t in texts])

    def counter(text: Column) -> Column:
        return count(text)

    return counter
