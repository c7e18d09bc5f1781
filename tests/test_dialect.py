import pytest

from keyhound.functions import dialect


@pytest.mark.parametrize(
    "text, pattern, want",
    [
        ("éab", r"\bab", True), ("ab\n", "ab$", False), ("a\rb", "a.b", True), ("a\u2028b", "a.b", True), ("a\x0bb", r"a\sb", False),
        ("\u212a", "(?i)k", True), ("é", r"\w", False), ("٣", r"\d", False), ("a]b", r"a[\]]b", True), ("x y", r"x[\s]y", True), ("a[b", "a[[]b", True),
        ("ab1", "[[:alpha:]]+1", True), ("a&b", "a[&]b", True), ("key=v", r"(?P<k_1>\w+)=", True), ("a\nb", "(?m)^a$", True), ("x.y", r"\Qx.y\E", True),
    ],
)
def test_translated_patterns_find_what_they_should(spark, text, pattern, want):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(F.rlike("t", F.lit(dialect.translate(pattern).java))).first()[0] is want


@pytest.mark.parametrize("pattern", [r"\b[0-9]{2}\b", r"\b(?:[a-c]x)?\b", r"\ba|-b\b", r"x?\by", r"a+\b", r"(a|-)\b", r"\b(a|-)", r"[A-z]\b", r"\b(?P<n>\d+)\b", r"a*\bb", r"-\ba", r"\b-a", r"\n\ba", r"(?i)\bk", r"\ba{0,1}-"])
def test_boundaries_are_as_in_sql(spark, pattern):
    import duckdb
    from pyspark.sql import functions as F

    texts = ["12", "a12", "12a", "-12-", "ax", "ax-", "cx bx", "-b", "a-b", "xy", "x y", "aa-", "aab", "é12é", "_12_", "1 2", "\u212a", "^", "a^b", "\na", "x\na", "k", "", "a-"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t: r.m for r in df.select("t", F.rlike("t", F.lit(dialect.translate(pattern).java)).alias("m")).collect()}
    c = duckdb.connect()
    assert got == {t: c.execute("SELECT regexp_matches(?, ?)", [t, pattern]).fetchone()[0] for t in texts}


@pytest.mark.parametrize("pattern", ["(?=a)", "(?<!a)b", r"(a)\1", "[a", "(?#x)", r"\k<a>"])
def test_patterns_outside_the_language_are_errors(pattern):
    with pytest.raises(dialect.PatternError):
        dialect.translate(pattern)


def test_named_groups_are_numbered():
    t = dialect.translate(r"(a)(?P<x_y>b)(?:c)(?P<z>d)")
    assert t.names == {"x_y": 2, "z": 3} and t.groups == 3


def test_globs_do_not_cross_slashes():
    import re

    assert re.match(dialect.glob("a/*").replace(r"\z", r"\Z"), "a/b")
    assert not re.match(dialect.glob("a/*").replace(r"\z", r"\Z"), "a/b/c")
