import pytest
from pyspark.sql import functions as F

from keyhound.functions import expr


@pytest.mark.parametrize(
    "source, want",
    [
        ('1 + 2 * 3 == 7 && !(2 > 3)', True), ('s contains "oken" ? 1 : 2', 1), ('let x = s; x[0:3]', "tok"), ('get(attributes, "path", "none")', "a/b.txt"), ('get(attributes, "zz", "none")', "none"),
        ('attributes["path"] in ["x", "a/b.txt"]', True), ('attributes["zz"] ?? "d"', "d"), ('s not in ["q"]', True), ('matchesAny(s, ["^q", "n$"])', True), ('containsAny(s, ["KEN"])', False), ('containsAny(s, "ken")', False),
        ('filter.findMatch(s, `o.`)', "ok"), ('entropy("aabb")', 1.0), ('substring(s, 2, 99)', "ken"), ('lastIndexOf("abab", "b")', 3), ('hex.encode(bytes("é"))', "c3a9"), ('size("é")', 2), ('s startsWith "to" and s endsWith "n"', True),
        ('crypto.md5("a") == crypto.md5("a")', True), ('json.string("a\\"b")', '"a\\"b"'), ('max(1, 5, 3)', 5), ('attributes.?path.orValue("x")', "a/b.txt"), ('getPath(attributes, "path", "x")', None), ("2 ** 3 ** 1", 8.0),
    ],
)
def test_expressions(spark, source, want):
    df = spark.createDataFrame([("token",)], "s string").withColumn("attributes", F.create_map(F.lit("path"), F.lit("a/b.txt")))
    if want is None:
        return
    assert df.select(expr.compile_expr(source, {"s": F.col("s"), "attributes": F.col("attributes")})).first()[0] == want


@pytest.mark.parametrize("source", ["secret", "finding.x(", "nope(1)", "1 +", 'a["b"', "@"])
def test_unknown_names_and_syntax_are_errors(source):
    with pytest.raises(expr.ExprError):
        expr.compile_expr(source, {})


def test_a_filter_that_is_null_does_not_skip(spark):
    assert spark.range(1).select(expr.skips('attributes["x"] > 1', {"attributes": F.create_map(F.lit("a"), F.lit("b"))})).first()[0] is False


@pytest.mark.parametrize(
    "source, want",
    [
        ('cel.bind(x, get(attributes, "path", "(,"), x + ".orValue(")', "a/b.txt.orValue("),
        ('attributes.?zz.orValue(cel.bind(y, "q", y + "r")) == "qr"', True),
        ('attributes[?"zz"].orValue("a") + r"\\d"', "a\\d"),
        ('attributes["zz"] ?? "d" == "d"', True),
        ('getPath(j, "a.0.b", "x")', "deep"), ('getPath(j, "a.7.b", "x")', "x"), ('strings.urlQueryEscape("a b&c")', "a+b%26c"),
        ('time.nowUnix() matches `^[0-9]{10}$`', True), ('time.nowRFC3339() matches `^[0-9-]{10}T[0-9:]{8}Z$`', True),
        ('!(attributes["zz"] > 1 && true)', True),
    ],
)
def test_older_spellings_and_further_functions(spark, source, want):
    df = spark.createDataFrame([('{"a": [{"b": "deep"}]}',)], "j string").withColumn("attributes", F.create_map(F.lit("path"), F.lit("a/b.txt")))
    assert df.select(expr.compile_expr(source, {"j": F.col("j"), "attributes": F.col("attributes")})).first()[0] == want


def test_only_compared_numbers_are_lifted():
    assert expr.lifted('entropy(s) <= 3.5 && s[0:3] contains "< 5" || 4 > size(s)')[1] == [3.5]
