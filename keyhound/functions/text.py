"""Functions of texts as Spark columns: entropies, containment, byte offsets, masks, escapes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dialect import joined


def lit_list(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def _entropy(units: Column, total: Column) -> Column:
    """Bits of the distribution of the units of an array, as shares of total. Sorted once, then counted in runs."""
    ordered = F.array_sort(units)
    zero = F.struct(F.lit("").alias("last"), F.lit(0.0).alias("run"), F.lit(0.0).alias("bits"))
    part = lambda n: F.when(n > 0, -(n / total) * F.log2(n / total)).otherwise(F.lit(0.0))
    step = lambda a, x: F.when(a["last"] == x, F.struct(a["last"].alias("last"), (a["run"] + 1.0).alias("run"), a["bits"].alias("bits"))).otherwise(
        F.struct(x.alias("last"), F.lit(1.0).alias("run"), (a["bits"] + part(a["run"])).alias("bits"))
    )
    return F.aggregate(ordered, zero, step, lambda a: a["bits"] + part(a["run"]))


def byte_entropy(s: Column) -> Column:
    """Shannon bits over bytes: the `entropy` of expressions."""
    pairs = F.regexp_extract_all(F.hex(s.cast("binary")), F.lit("(..)"), 1)
    return F.when(F.octet_length(s) > 0, _entropy(pairs, F.octet_length(s).cast("double"))).otherwise(F.lit(0.0))


def report_entropy(s: Column) -> Column:
    """Shannon bits over characters, as shares of the number of bytes: the entropy of findings."""
    return F.when(F.octet_length(s) > 0, _entropy(F.split(s, ""), F.octet_length(s).cast("double"))).otherwise(F.lit(0.0))


def fold(s: Column) -> Column:
    """Lower case for keyword search; the Kelvin sign and long s fold to ASCII."""
    rare = F.contains(s, F.lit("\u212a")) | F.contains(s, F.lit("\u017f"))
    return F.lower(F.when(rare, F.translate(s, "\u212a\u017f", "ks")).otherwise(s))


def contains_any(s: Column, terms: list[str]) -> Column:
    """Whether a term occurs in the lower-cased string; terms are taken as they are."""
    found = F.lit(False)
    for t in terms:
        found = found | F.contains(F.lower(s), F.lit(t))
    return found


def matches_any(s: Column, patterns: list[str]) -> Column:
    return F.rlike(s, F.lit(joined(patterns))) if patterns else F.lit(False)


def find_match(s: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_substr(s, F.lit(joined([pattern]))), F.lit(""))


def mask(s: Column, percent: int) -> Column:
    """The first characters of a secret and dots; all of it hidden from 100 percent on."""
    if percent >= 100:
        return F.lit("REDACTED")
    keep = F.bround(F.char_length(s) * F.lit((100 - percent) / 100.0)).cast("int")
    return F.concat(F.substring(s, F.lit(1), keep), F.lit("..."))


def count_of(s: Column, c: str) -> Column:
    return F.char_length(s) - F.char_length(F.replace(s, F.lit(c), F.lit("")))


def last_byte_of(s: Column, c: str) -> Column:
    """The byte offset of the last c in s, or 0."""
    tail = F.octet_length(F.substring_index(s, c, -1))
    return F.when(F.contains(s, F.lit(c)), F.octet_length(s) - tail - 1).otherwise(F.lit(0))


def bytes_between(s: Column, begin: Column, end: Column) -> Column:
    """The bytes [begin, end) as a string, clamped to the string."""
    a = F.greatest(begin, F.lit(0))
    b = F.least(end, F.octet_length(s))
    return F.substring(s.cast("binary"), (a + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int")).cast("string")


def scm_link(platform: Column, remote: Column, sha: Column, path: Column, start: Column, end: Column) -> Column:
    """A web link to lines of a file in a commit; inner paths of archives are cut off."""
    file = F.replace(F.replace(F.substring_index(path, "!", 1), F.lit("%"), F.lit("%25")), F.lit(" "), F.lit("%20"))
    inner = F.contains(path, F.lit("!"))
    s, e = start.cast("string"), end.cast("string")
    lines = lambda one, dash: F.when(inner, F.lit("")).otherwise(F.concat(F.lit(one), s, F.when(start != end, F.concat(F.lit(dash), e)).otherwise(F.lit(""))))
    return (
        F.when(platform == "github", F.concat(remote, F.lit("/blob/"), sha, F.lit("/"), file, lines("#L", "-L")))
        .when(platform == "gitlab", F.concat(remote, F.lit("/blob/"), sha, F.lit("/"), file, lines("#L", "-")))
        .when(platform == "gitea", F.concat(remote, F.lit("/src/commit/"), sha, F.lit("/"), file, lines("#L", "-L")))
        .when(platform == "bitbucket", F.concat(remote, F.lit("/src/"), sha, F.lit("/"), file, lines("#lines-", ":")))
        .otherwise(F.lit(""))
    )
