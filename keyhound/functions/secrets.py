"""Functions of secrets that Spark lacks, as Arrow functions of columns: keyed digests and obfuscation."""

from __future__ import annotations

import hmac
import random
import string

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

#: Share of characters that obfuscation changes, and which beginnings it keeps. Fixed values.
RATE = 0.7
LONG, KEEP, SEPARATORS = 20, 4, "-_."


def _keyed(digest: str):
    @F.pandas_udf(BinaryType())
    def go(keys: pd.Series, messages: pd.Series) -> pd.Series:
        return pd.Series([None if k is None or m is None else hmac.digest(bytes(k), bytes(m), digest) for k, m in zip(keys, messages, strict=True)])

    return lambda k, m: go(k.cast("binary"), m.cast("binary"))


hmac_sha1, hmac_sha256 = _keyed("sha1"), _keyed("sha256")


def obfuscated(secret: str, rng: random.Random) -> str:
    """A text of the same length and kinds of characters; of a long one the beginning up to a separator stays."""
    begin = 0
    if len(secret) > LONG:
        begin = next((i + 1 for i, c in enumerate(secret[:LONG]) if c in SEPARATORS), KEEP)
    body = secret[begin:]
    digits = "".join(sorted(set(body)))
    only = next((pool for pool in ("0123456789abcdef", "0123456789ABCDEF") if body and set(digits) <= set(pool) and not body.isdigit()), None)
    signs = [c for c in digits if not c.isalnum()]

    def other(c: str) -> str:
        pools = (only or "", string.digits, string.ascii_lowercase, string.ascii_uppercase)
        pool = next((p for p in pools if c in p), signs if c in signs else c)
        return rng.choice(pool)

    return secret[:begin] + "".join(other(c) if rng.random() < RATE else c for c in body)


@F.pandas_udf(StringType())
def _obfuscate(secrets: pd.Series) -> pd.Series:
    rng = random.SystemRandom()
    return secrets.map(lambda s: s if s is None else obfuscated(s, rng))


def obfuscate(c: Column) -> Column:
    return _obfuscate(c)


def unknown(code: Column) -> Column:
    """The result of a response that no rule of a validation knows: its status code says why."""
    reason = F.when(code == 429, F.lit("rate limited")).otherwise(F.concat(F.lit("HTTP "), code.cast("string")))
    return F.struct(F.lit("unknown").alias("result"), F.coalesce(reason, F.lit("")).alias("reason"))
