"""Operators on findings: composite rules, specificity, ignore lists, baselines, redaction, statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyhound.functions import text as T
from keyhound.plans.lineage import materialised
from keyhound.plans.rules import Config

MAX_SETS = 100
#: A component in sets; captures are sorted entries, since maps can't be compared.
_CAPTURES = "array<struct<key:string,value:string>>"
SETS = f"array<struct<components:array<struct<rule_id:string,start_line:int,end_line:int,start_column:int,end_column:int,match:string,secret:string,capture_groups:{_CAPTURES},specificity:int>>,validation_status:string,validation_reason:string>>"
_COMPONENT = ("rule_id", "start_line", "end_line", "start_column", "end_column", "match", "secret", "capture_groups", "specificity")


def _entries() -> Column:
    return F.array_sort(F.map_entries("capture_groups")).cast(_CAPTURES).alias("capture_groups")


def required_pairs(found: DataFrame, config: Config) -> DataFrame:
    """Primary findings with each component near enough: a band join within fragment and pass.

    Sets take a rule's components in order, lines first, and no more than MAX_SETS different ones. So where columns don't
    matter, components beyond the first MAX_SETS of their rule on a line (of a fragment, where lines don't matter
    either) are never needed and are left out before the join, and a line of thousands of findings makes at most
    MAX_SETS pairs for each. Components limited by columns meet by strips of that many columns.
    """
    needs = [(r.id, i, q.rule_id, q.within_lines, q.within_columns) for r in config.rules.values() for i, q in enumerate(r.required)]
    spark = found.sparkSession
    wanted = spark.createDataFrame(needs, "primary_id string, place int, required_id string, within_lines int, within_columns int")
    p = found.join(F.broadcast(wanted), F.col("rule_id") == F.col("primary_id"))  # as many rows as the rules require
    kinds = wanted.select("required_id", "within_lines", "within_columns").distinct()
    c = found.select(F.col("fragment_id").alias("f2"), F.col("pass").alias("p2"), F.col("rule_id").alias("r2"), F.struct(*[_entries() if c == "capture_groups" else c for c in _COMPONENT]).alias("component"))
    c = c.join(F.broadcast(kinds.select(F.col("required_id").alias("k2"), F.col("within_lines").alias("wl"), F.col("within_columns").alias("wc"))), F.col("r2") == F.col("k2")).drop("k2")
    line = F.when(F.col("wl").isNotNull(), F.col("component.start_line"))
    same = Window.partitionBy("f2", "p2", "r2", "wl", line).orderBy("component")
    free = c.where(F.col("wc").isNull()).withColumn("nth", F.dense_rank().over(same)).where(F.col("nth") <= MAX_SETS).drop("nth").withColumn("strip", F.lit(0))
    width = F.col("wc") + 1
    narrow = c.where(F.col("wc").isNotNull()).withColumn("strip", F.floor(F.col("component.start_column") / width).cast("int"))
    own = F.floor(F.col("start_column") / (F.col("within_columns") + 1)).cast("int")
    p = p.withColumn("own", F.explode(F.when(F.col("within_columns").isNull(), F.array(F.lit(0))).otherwise(F.array(own - 1, own, own + 1))))
    near = (F.col("within_lines").isNull() | (F.abs(F.col("start_line") - F.col("component.start_line")) <= F.col("within_lines"))) & (
        F.col("within_columns").isNull() | (F.abs(F.col("start_column") - F.col("component.start_column")) <= F.col("within_columns"))
    )
    keys = (F.col("fragment_id") == F.col("f2")) & (F.col("pass") == F.col("p2")) & (F.col("required_id") == F.col("r2")) & (F.col("own") == F.col("strip"))
    limits = F.col("within_lines").eqNullSafe(F.col("wl")) & F.col("within_columns").eqNullSafe(F.col("wc"))
    return p.join(free.unionByName(narrow), keys & limits & near).drop("wl", "wc", "own", "strip")


def required_sets(groups: Column) -> Column:
    """The product of arrays of components, of which no more than MAX_SETS are kept at any level."""
    one = F.from_json(F.lit('[{"components": []}]'), SETS)["components"]
    step = lambda acc, g: F.slice(F.flatten(F.transform(acc, lambda s: F.transform(g, lambda c: F.array_append(s, c)))), 1, MAX_SETS)
    return F.transform(F.aggregate(groups, one, step), lambda s: F.struct(s.alias("components"), F.lit("").alias("validation_status"), F.lit("").alias("validation_reason"))).cast(SETS)


def composed(found: DataFrame, config: Config) -> DataFrame:
    """Findings to report, with required_sets; a composite stays only if every rule that it requires is near."""
    key = ["fragment_id", "pass", "rule_id", "start_line", "start_column", "end_line", "end_column", "secret"]
    primaries = {r.id: len({q.rule_id for q in r.required}) for r in config.rules.values() if r.required}
    if not primaries:
        return found.where(~F.col("skip_report")).withColumn("required_sets", F.lit(None).cast(SETS))
    # Sets hold the first MAX_SETS at most, so no rule needs more of its components; ranks are limited before the shuffle.
    first = Window.partitionBy(*key, "required_id").orderBy("component")
    pairs = required_pairs(found, config).select(*key, "required_id", "place", "component").withColumn("nth", F.dense_rank().over(first)).where(F.col("nth") <= MAX_SETS)
    per_rule = pairs.groupBy(*key, "required_id").agg(F.array_sort(F.collect_set("component")).alias("cs"), F.min("place").alias("place"))
    sets = per_rule.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("place", "required_id", "cs"))).alias("g"))
    sets = sets.select(*key, F.size("g").alias("n_required"), required_sets(F.transform("g", lambda g: g["cs"])).alias("required_sets"))
    need = F.coalesce(F.create_map(*[x for k, v in primaries.items() for x in (F.lit(k), F.lit(v))])[F.col("rule_id")], F.lit(0))
    out = found.where(~F.col("skip_report")).join(sets, key, "left")
    return out.where((need == 0) | (F.coalesce("n_required", F.lit(0)) == need)).drop("n_required")


def suppressed(found: DataFrame) -> DataFrame:
    """Findings that no finding of higher specificity covers, and that aren't components of a composite.

    All conditions share fragment and line as equal keys, so that they are hash joins with a small rest. Secrets are
    compared once each, not once a finding, and only with secrets of a line that has more than one specificity.
    """
    sha = lambda c: F.coalesce(F.try_element_at(c, F.lit("git.sha")), F.lit(""))
    keys = ["fragment_id", "start_line"]
    secrets = found.select(*keys, "secret", "specificity", sha("attributes").alias("sha")).distinct()
    levels = secrets.groupBy(*keys, "sha").agg(F.min("specificity").alias("low"), F.max("specificity").alias("high")).where("low < high")
    mixed = secrets.join(levels, [*keys, "sha"])
    low = mixed.where("specificity < high").select(*keys, "sha", "secret", "specificity")
    high = mixed.where("specificity > low").select(*keys, "sha", F.col("secret").alias("s2"), F.col("specificity").alias("p2"))
    # A rule has one specificity, so a higher one is another rule's.
    covered = low.join(high, [*keys, "sha"]).where(F.contains("s2", F.col("secret")) & (F.col("p2") > F.col("specificity"))).select(*keys, F.col("sha").alias("sha_"), "secret", "specificity").distinct()
    on = lambda d, other, names: [d[n].eqNullSafe(other[n]) for n in names]
    same = [*on(found, covered, [*keys, "secret", "specificity"]), sha(found["attributes"]) == covered["sha_"]]
    out = found.join(covered, reduce(lambda a, b: a & b, same), "left_anti")
    if "required_sets" in found.columns:
        sets = out.where(F.col("required_sets").isNotNull()).select("fragment_id", F.explode("required_sets").alias("s"))
        c = sets.select(F.col("fragment_id").alias("f2"), F.explode("s.components").alias("c"))
        c = c.select("f2", F.col("c.start_line").alias("l2"), F.col("c.secret").alias("s2"), F.col("c.specificity").alias("p2")).distinct()
        here = (F.col("fragment_id") == F.col("f2")) & (F.col("start_line") == F.col("l2"))
        exact = out.join(c.select("f2", "l2", "s2").distinct(), here & F.col("secret").eqNullSafe(F.col("s2")), "left_anti")
        inside = F.contains("s2", F.col("secret")) & (F.col("p2") > F.col("specificity"))
        out = exact.join(c, here & inside, "left_anti")
    return out


def ignore_rows(lines: DataFrame, column: str = "value") -> DataFrame:
    """The fingerprints of an ignore file's lines; comments and blank lines go, backslashes of paths become slashes."""
    text = F.btrim(F.col(column), F.lit(" \t\r\n"))
    rows = lines.select(text.alias("t")).where((F.col("t") != "") & ~F.startswith("t", F.lit("#")))
    return rows.select(F.replace("t", F.lit("\\"), F.lit("/")).alias("ignored")).distinct()


def without_ignored(found: DataFrame, ignored: DataFrame) -> DataFrame:
    """Findings whose fingerprint, with its commit or without, isn't listed."""
    global_ = F.concat_ws(":", F.coalesce(F.try_element_at("attributes", F.lit("path")), F.lit("")), "rule_id", F.col("start_line").cast("string"))
    out = found.join(ignored, F.col("fingerprint") == F.col("ignored"), "left_anti")
    return out.join(ignored, global_ == F.col("ignored"), "left_anti")


def without_baseline(found: DataFrame, baseline: DataFrame, redacted: bool = False) -> DataFrame:
    """Findings that no row of a baseline equals; match and secret aren't compared where they are redacted."""
    cols = ["rule_id", "description", "start_line", "end_line", "start_column", "end_column", "entropy"] + ["match", "secret"] * (not redacted)
    attrs = [a for a in ("path", "git.sha", "git.author_name", "git.author_email", "git.date", "git.message")]
    b = baseline.select(*[F.col(c).alias(f"b_{c}") for c in cols], F.col("attributes").alias("b_attributes"))
    of = lambda m, a: F.coalesce(F.try_element_at(m, F.lit(a)), F.lit(""))
    same = [F.col(c).eqNullSafe(F.col(f"b_{c}")) for c in cols] + [of(F.col("attributes"), a) == of(F.col("b_attributes"), a) for a in attrs]
    return found.join(b, reduce(lambda x, y: x & y, same), "left_anti")


def redacted(found: DataFrame, percent: int = 100) -> DataFrame:
    """Findings with the secret masked, in match, line, context and captures too, and in components of sets theirs."""
    if percent <= 0:
        return found
    hidden = T.mask(F.col("secret"), percent)
    swap = lambda c: F.when(F.col("secret") == "", c).otherwise(F.replace(c, F.col("secret"), hidden))
    out = found.withColumn("match", swap(F.col("match"))).withColumn("line", swap(F.col("line")))
    out = out.withColumn("capture_groups", F.transform_values("capture_groups", lambda k, v: swap(v)))
    if "match_context" in found.columns:
        out = out.withColumn("match_context", swap(F.col("match_context")))
    if "required_sets" in found.columns:

        def covered(c: Column) -> Column:
            own = T.mask(c["secret"], percent)
            within = lambda x: F.when(c["secret"] == "", x).otherwise(F.replace(x, c["secret"], own))
            captures = F.transform(c["capture_groups"], lambda e: F.struct(e["key"].alias("key"), within(e["value"]).alias("value")))
            return c.withField("match", within(c["match"])).withField("capture_groups", captures).withField("secret", own)

        out = out.withColumn("required_sets", F.transform("required_sets", lambda s: s.withField("components", F.transform(s["components"], covered))))
    return out.withColumn("secret", hidden)


def rule_stats(found: DataFrame) -> DataFrame:
    return found.groupBy("rule_id").agg(F.count("*").alias("hits"), F.count_distinct("secret").alias("secrets"), F.round(F.avg(F.col("entropy").cast("double")), 4).alias("avg_entropy"))


def scan(fragments: DataFrame, config: Config, depth: int = 0, redact: int = 0, ignored: DataFrame | None = None, baseline: DataFrame | None = None, **options) -> DataFrame:
    """The whole pipeline: findings of plain and decoded text, composed, suppressed, less what is known, redacted."""
    from .decode import decoded_findings
    from .scan import findings, spread

    fragments = spread(fragments)
    found = findings(fragments, config, **options)
    if depth:
        found = found.unionByName(decoded_findings(fragments, config, depth, **options))
    # What follows joins findings to findings; the texts are scanned once, and findings are small beside them.
    found = suppressed(composed(materialised(found), config))
    if ignored is not None:
        found = without_ignored(found, ignored)
    if baseline is not None:
        found = without_baseline(found, baseline, redact > 0)
    return redacted(found, redact)
