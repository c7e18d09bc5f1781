"""Validation of findings against a table of responses: one evaluation for each key, then the best status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyhound.plans.lineage import materialised

#: Statuses by rank, best first. Fixed values.
RANKS = ("valid", "needs_validation", "revoked", "unknown", "invalid", "error")


def key(rule_id: Column, secret: Column, captures: Column | None = None) -> Column:
    """What findings of one secret share: a hash of rule, secret and captures in order of their names."""
    nul = F.lit("\0")
    parts = [rule_id, nul, secret]
    if captures is not None:
        pairs = F.array_sort(F.map_entries(captures))
        parts.append(F.array_join(F.transform(pairs, lambda e: F.concat(nul, e["key"], nul, e["value"])), ""))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def status(s: Column) -> Column:
    low = F.lower(F.coalesce(s, F.lit("")))
    return F.when(low.isin(*RANKS), low).otherwise(F.lit("unknown"))


def rank(s: Column) -> Column:
    out = F.lit(0)
    for i, name in enumerate(RANKS):
        out = F.when(s == name, F.lit(len(RANKS) - i)).otherwise(out)
    return out


def _metadata(keep_empty: bool) -> Column:
    return F.col("metadata") if keep_empty else F.map_filter("metadata", lambda k, v: v.isNotNull() & (v != ""))


def validated(found: DataFrame, responses: DataFrame, evaluate=None, keep_empty: bool = False) -> DataFrame:
    """found with validation_status, validation_reason and validation_meta (without empty values, or with them).

    responses: key, result, reason, metadata (map). evaluate: instead of a join, a function from the distinct keys
    (key, rule_id, secret) to such rows; each key is evaluated once, however many findings share it.
    """
    keyed = found.withColumn("key", key(F.col("rule_id"), F.col("secret"), F.col("capture_groups")))
    if evaluate is not None:
        responses = evaluate(keyed.select("key", "rule_id", "secret").distinct())
    r = responses.select("key", status(F.col("result")).alias("validation_status"), F.coalesce("reason", F.lit("")).alias("validation_reason"), _metadata(keep_empty).alias("validation_meta"))
    out = keyed.join(r, "key", "left").drop("key")
    return out.withColumn("validation_status", F.coalesce("validation_status", F.lit("")))


def merged_captures(captures: Column, components: Column) -> Column:
    """A finding's captures, and of each component its secret by rule and its captures by `rule:name`; the last one counts."""
    of = lambda c: F.concat(
        F.array(F.struct(c["rule_id"].alias("key"), c["secret"].alias("value"))),
        F.transform(c["capture_groups"], lambda e: F.struct(F.concat(c["rule_id"], F.lit(":"), e["key"]).alias("key"), e["value"].alias("value"))),
    )
    entries = "array<struct<key:string,value:string>>"
    more = F.flatten(F.transform(components, of)).cast(entries)
    put = lambda acc, e: F.array_append(F.filter(acc, lambda x: x["key"] != e["key"]), e)
    return F.map_from_entries(F.aggregate(more, F.map_entries(captures).cast(entries), put))


def validated_sets(found: DataFrame, responses: DataFrame | None, evaluate=None, keep_empty: bool = False) -> DataFrame:
    """validated() for findings with required_sets: each set has a key, a status and a reason of its own.

    A finding takes the best status of its sets, of the first that has it, and keeps only valid sets if any is valid.
    Findings without sets are validated by their own captures. evaluate: from the distinct keys (key, rule_id, secret,
    captures) to rows like responses. No finding has more sets than the composition allows, so groups are bounded.
    """
    has = F.size(F.coalesce("required_sets", F.array())) > 0
    own = F.coalesce("capture_groups", F.create_map().cast("map<string,string>"))
    each = F.when(has, F.transform("required_sets", lambda s: merged_captures(own, s["components"]))).otherwise(F.array(own))
    f = materialised(found.withColumn("finding_no", F.monotonically_increasing_id()))
    sets = f.select("finding_no", "rule_id", "secret", F.posexplode(each).alias("place", "captures"))
    sets = sets.withColumn("key", key(F.col("rule_id"), F.col("secret"), F.col("captures")))
    if evaluate is not None:
        responses = evaluate(sets.select("key", "rule_id", "secret", "captures").dropDuplicates(["key"]))
    r = responses.select("key", status(F.col("result")).alias("s"), F.coalesce("reason", F.lit("")).alias("why"), F.array_sort(F.map_entries(_metadata(keep_empty))).alias("meta"))
    got = sets.select("finding_no", "place", "key").join(r, "key", "left").withColumn("s", F.coalesce("s", F.lit(""))).withColumn("why", F.coalesce("why", F.lit("")))
    got = got.groupBy("finding_no").agg(F.array_sort(F.collect_list(F.struct("place", "s", "why"))).alias("all"), F.max(F.struct(rank(F.col("s")).alias("rank"), (-F.col("place")).alias("first"), "s", "why", "meta")).alias("best"))
    out = f.join(got, "finding_no")
    marked = F.transform("required_sets", lambda s, i: s.withField("validation_status", F.get("all", i)["s"]).withField("validation_reason", F.get("all", i)["why"]))
    out = out.withColumn("required_sets", F.when(has, marked).otherwise(F.col("required_sets")))
    valid = lambda s: s["validation_status"] == "valid"
    kept = F.when(F.exists("required_sets", valid), F.filter("required_sets", valid)).otherwise(F.col("required_sets"))
    out = out.withColumns({"required_sets": kept, "validation_status": F.col("best.s"), "validation_reason": F.col("best.why"), "validation_meta": F.map_from_entries("best.meta")})
    return out.drop("finding_no", "all", "best")


def rollup(rows: DataFrame, by: list[str], place: str) -> DataFrame:
    """The best status of each group, with the reason of the first row that has it."""
    best = F.max_by(F.struct("validation_status", "validation_reason"), F.struct(rank(F.col("validation_status")), -F.col(place)))
    return rows.groupBy(*by).agg(best.alias("b")).select(*by, F.col("b.validation_status").alias("validation_status"), F.col("b.validation_reason").alias("validation_reason"))


def status_counts(found: DataFrame) -> DataFrame:
    return found.groupBy(F.coalesce(F.nullif("validation_status", F.lit("")), F.lit("none")).alias("status")).agg(F.count("*").alias("n"))


def with_status(found: DataFrame, wanted: list[str]) -> DataFrame:
    """Findings of the wanted statuses; `none` is none at all."""
    return found.where(F.coalesce(F.nullif("validation_status", F.lit("")), F.lit("none")).isin(wanted))
