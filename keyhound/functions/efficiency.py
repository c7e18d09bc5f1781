"""Token efficiency of secrets: how many bytes a tokenizer's token holds, with any vocabulary and word list."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MIN_WORD, RATIO, SHORT, SHORT_RATIO = 5, 2.5, 12, 2.1


def shortened(secret: str) -> str:
    """A short secret without its line ends."""
    return secret.replace("\n", "").replace("\r", "") if len(secret.encode()) < 20 else secret


def fails(secret: str, count_tokens, words: frozenset[str]) -> bool:
    """Whether a secret looks like language: it holds a word, or its tokens are long."""
    s = shortened(secret)
    n = count_tokens(s)
    if not n:
        return False
    low = s.lower()
    inside = lambda least: any(low[i : i + k] in words for k in range(least, 16) for i in range(len(low) - k + 1))
    if inside(MIN_WORD):
        return True
    size = len(s.encode())
    return size / n >= (SHORT_RATIO if size < SHORT and inside(4) else RATIO)


def column(vocabulary: str, words: frozenset[str]):
    """A function of a column, for expressions; vocabulary: the path of a file of the tokenizers library."""
    loaded: list = []  # the tokenizer, once a task

    @F.pandas_udf("boolean")
    def go(secrets: pd.Series) -> pd.Series:
        from tokenizers import Tokenizer

        if not loaded:
            loaded.append(Tokenizer.from_file(vocabulary))
        distinct = [*{s for s in secrets if s}]
        sized = [shortened(s) for s in distinct]
        counts = [len(e.ids) for e in loaded[0].encode_batch_fast(sized, add_special_tokens=False)]
        found = {s: fails(s, lambda _, n=n: n, words) for s, n in zip(distinct, counts, strict=True)}
        return secrets.map(lambda s: found.get(s, False))

    return lambda c: go(c) if isinstance(c, Column) else go(F.lit(c))
