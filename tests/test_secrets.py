import hashlib
import hmac
import random

from pyspark.sql import functions as F

from keyhound.functions import expr
from keyhound.functions.secrets import obfuscated


def test_keyed_digests_equal_the_library(spark):
    df = spark.createDataFrame([("k", "m")], "k string, m string")
    for name in ("sha1", "sha256"):
        said = f"hex.encode(crypto.hmac{name.title()}(bytes(k), bytes(m)))"
        assert df.select(expr.compile_expr(said, {"k": F.col("k"), "m": F.col("m")})).first()[0] == hmac.new(b"k", b"m", getattr(hashlib, name)).hexdigest()


def test_obfuscation_keeps_length_kinds_and_beginnings():
    rng = random.Random(0)
    for s in ("", "abc", "sk-live-0123456789abcdefXYZ", "0123456789abcdef" * 2, "ÄÖ!?x9"):
        for _ in range(20):
            o = obfuscated(s, rng)
            assert len(o) == len(s)
            assert all((a.isdigit(), a.isupper(), a.isalpha()) == (b.isdigit(), b.isupper(), b.isalpha()) for a, b in zip(s, o)) or set(s) <= set("0123456789abcdef")
    assert obfuscated("sk-live-0123456789abcdefXYZ", rng).startswith("sk-")
    assert set(obfuscated("0123456789abcdef" * 2, rng)) <= set("0123456789abcdef")


def test_unknown_results_and_environment(spark):
    scope = {"r": {"status": F.lit(429)}, "q": {"status": F.lit(500)}, "__environment__": {"A": "1"}}
    at = lambda s: spark.range(1).select(expr.compile_expr(s, scope)).first()[0]
    assert at("validate.unknown(r)").reason == "rate limited" and at("unknown(q)").reason == "HTTP 500"
    assert at('env.get("A")') == "1" and at('env.getOrDefault("B", "d")') == "d"
