"""The scan: fragments by rules to findings.

Fragments are rows (fragment_id, raw, start_line, attributes). One pass over a text's Arrow batch looks up the keywords
of all rules in one automaton and gives the rules that the fragment is a candidate of; only their patterns are matched,
with Spark's own functions, and only matches leave the text. Patterns stand in one constant array, and what else is known
of a rule in a small table that matches are joined to by the rule's number, so the plan has one scan of the source and
the same size for any number of rules. Rules whose filters differ in numbers only share one compiled filter. Nothing is shuffled before
composite rules.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyhound.functions import dialect, keywords
from keyhound.functions import text as T
from keyhound.functions.expr import lifted, skips
from keyhound.plans.rules import Config, Rule

#: Sources of this many tasks are never spread over more.
SPREAD = 64
#: Comments that keep a line from being reported; callers add the ones that their texts already hold.
ALLOW = ("keyhound:allow",)
#: The context that filters see: so many lines and bytes around a match. Fixed values.
FILTER_CONTEXT = ("box", 350, 350, 20, 20)
_RULE = "number int, id string, description string, java string, secret_group int, groups int, names array<string>, places array<int>, tags array<string>, specificity int, skip_report boolean, shape int, numbers array<double>"


def fragments(df: DataFrame, raw: str, fragment_id: str, path: Column | None = None, start_line: int = 1, attributes: Column | None = None) -> DataFrame:
    """Rows of any table as fragments. A path given apart wins over one among the attributes; null attributes are none."""
    none = F.create_map().cast("map<string,string>")
    given = F.coalesce(attributes.cast("map<string,string>"), none) if attributes is not None else none
    own = given if path is None else F.map_concat(F.map_filter(given, lambda k, v: k != "path"), F.create_map(F.lit("path"), path))
    return df.select(
        F.col(fragment_id).alias("fragment_id"),
        F.coalesce(F.col(raw), F.lit("")).alias("raw"),
        F.lit(start_line).alias("start_line"),
        own.alias("attributes"),
    )


def spread(df: DataFrame) -> DataFrame:
    """Fragments over as many tasks as the session has slots, where their source gives few (a file of one row group).

    Only sources of under SPREAD tasks are shuffled for it, once and before the costly part; others stay as they are read.
    """
    if df.isStreaming:
        return df
    slots = min(SPREAD, df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(slots, "fragment_id") if df.rdd.getNumPartitions() < slots else df


def prefiltered(df: DataFrame, config: Config) -> DataFrame:
    """Fragments that the global prefilter doesn't skip, that have something in them, and that aren't our own files."""
    path = F.coalesce(F.try_element_at("attributes", F.lit("path")), F.lit(""))
    df = df.where((F.octet_length("raw") > 0) | (path != ""))
    if config.path:
        df = df.where(path != config.path)
    return df.where(~skips(config.prefilter, {"attributes": F.col("attributes")})) if config.prefilter else df


def _shapes(rules: list[Rule]) -> tuple[list[str], list[tuple[int | None, list[float]]]]:
    """The distinct filters of rules with their numbers lifted out, and each rule's: which one, and its numbers."""
    shapes: dict[str, int] = {}
    own = []
    for r in rules:
        if not r.filter:
            own.append((None, []))
            continue
        shape, numbers = lifted(r.filter)
        own.append((shapes.setdefault(shape, len(shapes)), numbers))
    return list(shapes), own


def described(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """What is known of the rules: number, and r, a struct of it all."""
    rows = []
    for i, (r, (shape, numbers)) in enumerate(zip(rules, _shapes(rules)[1], strict=True)):
        t = dialect.translate(r.regex) if r.regex else None
        names, places = ([*t.names], [*t.names.values()]) if t else ([], [])
        rows.append((i, r.id, r.description, t and t.java, r.secret_group, t.groups if t else 0, names, places, [*r.tags], r.specificity, r.skip_report, shape, numbers))
    return df.sparkSession.createDataFrame(rows, _RULE).select("number", F.struct("*").alias("r"))


def keyword_candidates(df: DataFrame, config: Config) -> DataFrame:
    """fragment_id, rule_id for each rule that a fragment is a candidate of."""
    rules = list(config.rules.values())
    ids = F.array(*map(F.lit, config.rules)) if rules else F.array().cast("array<string>")
    found = df.select("fragment_id", F.explode(keywords.candidates([r.keywords for r in rules])(F.col("raw"))).alias("rule"))
    return found.select("fragment_id", F.element_at(ids, F.col("rule") + 1).alias("rule_id"))


def find_all(raw: Column, java: Column) -> Column:
    """Matches with the offsets (characters and bytes) of their starts, from the matches and the texts between them."""
    found = F.regexp_extract_all(raw, java, 0)
    between = F.split(raw, java, -1)
    pairs = F.arrays_zip(found.alias("m"), F.slice(between, F.lit(1), F.size(found)).alias("b"))
    zero = F.struct(F.array().cast("array<struct<match:string,cstart:int,bstart:int>>").alias("all"), F.lit(0).alias("c"), F.lit(0).alias("b"))
    step = lambda a, x: F.struct(
        F.array_append(a["all"], F.struct(x["m"].alias("match"), (a["c"] + F.char_length(x["b"])).alias("cstart"), (a["b"] + F.octet_length(x["b"])).alias("bstart"))).alias("all"),
        (a["c"] + F.char_length(x["b"]) + F.char_length(x["m"])).alias("c"),
        (a["b"] + F.octet_length(x["b"]) + F.octet_length(x["m"])).alias("b"),
    )
    return F.aggregate(pairs, zero, step, lambda a: a["all"])


def raw_matches(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """df's rows by their matches: rule (its number), rule_id, match, cstart, bstart."""
    names = df.columns
    path = F.coalesce(F.try_element_at("attributes", F.lit("path")), F.lit(""))
    patterns = [{"id": r.id, "java": dialect.translate(r.regex).java if r.regex else None, "path": dialect.translate(r.path).java if r.path else None} for r in rules]
    known = F.from_json(F.lit(json.dumps(patterns)), "array<struct<id:string,java:string,path:string>>")  # a constant of the plan
    of = lambda n: F.element_at(known, n + 1)
    # Rules are tested on the fragment before it is repeated for any of them.
    held = lambda n: (of(n)["java"].isNull() | F.rlike("raw", F.coalesce(of(n)["java"], F.lit("")))) & (of(n)["path"].isNull() | (path != "") & F.rlike(path, F.coalesce(of(n)["path"], F.lit(""))))
    df = df.withColumn("candidates", keywords.candidates([r.keywords for r in rules])(F.col("raw")))
    df = df.withColumn("rule", F.explode(F.filter("candidates", held))).withColumn("java", of(F.col("rule"))["java"])
    only = F.struct(F.lit(None).cast("string").alias("match"), F.lit(0).alias("cstart"), F.lit(0).alias("bstart"))
    df = df.withColumn("m", F.explode(F.when(F.col("java").isNull(), F.array(only)).otherwise(find_all(F.col("raw"), F.col("java")))))
    return df.select(*names, "rule", of(F.col("rule"))["id"].alias("rule_id"), "m.match", "m.cstart", "m.bstart")


def trimmed(df: DataFrame) -> DataFrame:
    """Matches without newlines at their ends. The start stays; the end follows the trimmed length."""
    return df.withColumn("full_end", F.col("bstart") + F.octet_length("match")).withColumn("match", F.btrim("match", F.lit("\n"))).withColumn("bend", F.col("bstart") + F.octet_length("match"))


def located(df: DataFrame) -> DataFrame:
    """Adds start_line_, end_line, start_column, end_column and line to matches (raw, start_line, cstart, bstart, bend, span).

    Lines are counted from the fragment's own; columns count bytes from the newline before, so that the first
    character after a newline has column 2. A line's text begins with that newline. Past the last newline of a text that has some, the
    text shown begins with the fragment.
    """
    upto = F.substring(F.col("raw"), F.lit(1), F.col("cstart") + 1)
    end_ = F.substring(F.col("raw"), F.lit(1), F.col("cstart") + F.char_length("span"))
    after = F.substring(F.col("raw"), F.col("cstart") + 2, F.char_length("raw"))
    rest = F.substring(F.col("raw"), F.col("cstart") + F.char_length("span") + 1, F.char_length("raw"))
    d = df.withColumns({"n_all": T.count_of(F.col("raw"), "\n"), "n_start": T.count_of(upto, "\n"), "n_end": T.count_of(end_, "\n"), "p_start": T.last_byte_of(upto, "\n"), "p_end": T.last_byte_of(end_, "\n")})
    plain = F.col("n_all") == 0
    in_lines = plain | (F.col("n_all") > F.col("n_start"))
    ends = plain | (F.col("n_all") > F.col("n_end"))
    next_start = F.octet_length(upto) + F.octet_length(F.substring_index(after, "\n", 1))
    next_end = F.octet_length(end_) + F.octet_length(F.substring_index(rest, "\n", 1))
    next_any = F.octet_length(end_) + F.octet_length(F.regexp_extract(rest, r"\A[^\n\r]*", 0))
    d = d.withColumns(
        {
            "l_start": F.when(in_lines, F.col("n_start")).otherwise(F.col("n_all")),
            "l_end": F.when(~in_lines, F.col("n_all")).when(ends, F.col("n_end")).otherwise(F.col("n_start")),
            "start_column": F.col("bstart") - F.col("p_start") + 1,
            "end_column": F.when(~in_lines, F.col("bend") - F.col("p_start")).when(ends, F.col("bend") - F.col("p_end")).otherwise(F.lit(0)),
            "line_from": F.when(in_lines, F.col("p_start")).otherwise(F.lit(0)),
            "line_to": F.when(~in_lines, next_any).when(ends, next_end).otherwise(next_start),
        }
    )
    d = d.withColumn("line", T.bytes_between(F.col("raw"), F.col("line_from"), F.col("line_to")))
    d = d.withColumn("end_line", F.col("start_line") + F.col("l_end")).withColumn("start_line_", F.col("start_line") + F.col("l_start"))
    return d.drop("n_all", "n_start", "n_end", "p_start", "p_end", "l_start", "l_end", "line_from", "line_to")


def _group(match: Column, r: Column, i: Column) -> Column:
    return F.call_function("regexp_extract", match, r["java"], i)


def _secret(match: Column, r: Column) -> Column:
    """The chosen group, or the first that isn't empty, matched anew on the match."""
    numbers = F.when(r["groups"] > 0, F.sequence(F.lit(1), r["groups"])).otherwise(F.array().cast("array<int>"))
    first = F.try_element_at(F.filter(F.transform(numbers, lambda i: _group(match, r, i)), lambda x: x != ""), F.lit(1))
    return F.when(r["java"].isNull(), F.lit("")).when(r["secret_group"] > 0, _group(match, r, r["secret_group"])).otherwise(F.coalesce(first, match))


def _captures(match: Column, r: Column) -> Column:
    all_ = F.map_from_arrays(r["names"], F.transform(r["places"], lambda i: _group(match, r, i)))
    return F.when(F.size(r["names"]) > 0, F.map_filter(all_, lambda k, v: v != "")).otherwise(F.create_map().cast("map<string,string>"))


def findings(df: DataFrame, config: Config, functions: dict | None = None, ignore_allow: bool = False, context: str = "", allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """Findings of all rules in fragments, after filters and before composition and suppression.

    functions: more functions of expressions, by name, as functions of columns.
    """
    m = trimmed(raw_matches(prefiltered(df, config), list(config.rules.values())))
    m = m.withColumns({"span": F.coalesce("match", F.lit("")), "scanned": F.col("raw"), "decoded_line": F.lit(None).cast("string"), "more_tags": F.array().cast("array<string>"), "pass": F.lit(0), "at": F.col("bstart")})
    return finish(m, config, functions, ignore_allow, context, allow)


def finish(m: DataFrame, config: Config, functions: dict | None = None, ignore_allow: bool = False, context: str = "", allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """Findings of matches: location, secret, filters, fingerprint."""
    rules = list(config.rules.values())
    m = located(m)
    path = F.try_element_at("attributes", F.lit("path"))
    only_path = F.col("match").isNull()
    if not ignore_allow and allow:
        allowed = reduce(lambda a, b: a | b, [F.contains("line", F.lit(x)) for x in allow])
        m = m.where(only_path | ~F.coalesce(allowed, F.lit(False)))
    m = m.join(F.broadcast(described(m, rules)), F.col("rule") == F.col("number")).drop("number")  # a row for each rule
    r = F.col("r")
    m = m.withColumn("secret", _secret(F.col("match"), r)).withColumn("capture_groups", _captures(F.col("match"), r))
    m = m.withColumn("entropy", T.report_entropy(F.col("secret")).cast("float"))
    if config.filter or any(x.filter for x in rules):
        low, high = F.col("at"), F.col("full_end")
        until = lambda c: F.octet_length(F.regexp_extract(c, r"\A[^\n\r]*", 0))
        head, tail = T.bytes_between(F.col("scanned"), F.lit(0), low), T.bytes_between(F.col("scanned"), high, F.octet_length("scanned"))
        finding = {
            "secret": F.col("secret"), "match": F.col("match"), "line": F.coalesce("decoded_line", "line"), "rule_id": F.col("rule_id"), "description": r["description"],
            "entropy": F.col("entropy").cast("string"), "fragment_raw": F.col("scanned"), "match_start_idx": low, "match_end_idx": high, "context": box(*FILTER_CONTEXT[1:]),
            "match_line_start_idx": low - until(F.reverse(head)), "match_line_end_idx": high + until(tail),
        }
        scope = {"attributes": F.col("attributes"), "finding": finding, "__functions__": functions or {}}
        skip = skips(config.filter, scope) if config.filter else F.lit(False)
        own = None
        for i, shape in enumerate(_shapes(rules)[0]):
            numbers = {f"__n{k}": F.try_element_at(r["numbers"], F.lit(k + 1)) for k in range(shape.count("__n"))}
            value = skips(shape, scope | numbers)
            own = F.when(r["shape"] == i, value) if own is None else own.when(r["shape"] == i, value)
        m = m.where(only_path | ~(skip if own is None else skip | F.coalesce(own, F.lit(False))))
    sha = F.coalesce(F.try_element_at("attributes", F.lit("git.sha")), F.lit(""))
    place = F.concat_ws(":", F.coalesce(path, F.lit("")), "rule_id", F.col("start_line_").cast("string"))
    m = m.withColumn("fingerprint", F.when(only_path, F.lit("")).when(sha != "", F.concat(sha, F.lit(":"), place)).otherwise(place))
    extra = [around(context)] if context else []
    m = m.withColumn("shown", F.coalesce("match", F.concat(F.lit("file detected: "), path)))
    return m.select(
        "fragment_id", "rule_id", r["description"].alias("description"), F.col("start_line_").alias("start_line"), "end_line", "start_column", "end_column", F.col("shown").alias("match"), "secret",
        F.coalesce("line", F.lit("")).alias("line"), "capture_groups", "attributes", F.concat(r["tags"], "more_tags").alias("tags"),
        r["specificity"].alias("specificity"), r["skip_report"].alias("skip_report"), "entropy", "fingerprint", "pass", *extra,
    )


def context_spec(spec: str) -> tuple[str, int, int, int, int]:
    """mode, columns before and after, lines before and after, of `10L`, `-2C,+4C` and the like; L counts the match's line."""
    import re

    cols, lines = [0, 0], [0, 0]
    parts = [p.strip() for p in spec.split(",") if p.strip()]
    for p in parts:
        m = re.fullmatch(r"([+-]?)(\d+)([CL])", p)
        if not m:
            raise ValueError(f"unknown context {p!r}")
        n = int(m[2]) - (m[3] == "L")
        for i, sign in enumerate("-+"):
            if m[1] in ("", sign):
                (lines if m[3] == "L" else cols)[i] = max(0, n)
    mode = "none" if not parts else "box" if "L" in spec else "cols"
    return mode, *cols, *lines


def box(before: int, after: int, up: int, down: int) -> Column:
    """The lines around a match; of a match within one line, also only the columns around it. Shorter lines are shown whole."""
    at = T.count_of(F.substring(F.col("raw"), F.lit(1), F.col("cstart")), "\n")
    last = at + T.count_of(F.col("span"), "\n")
    first = F.greatest(at - up, F.lit(0))
    rows = F.slice(F.split("raw", "\n", -1), first + 1, last + down - first + 1)
    if before or after:
        column = F.octet_length(F.substring_index(F.substring(F.col("raw"), F.lit(1), F.col("cstart")), "\n", -1))
        low, high = F.greatest(column - before, F.lit(0)), column + F.octet_length("span") + after
        clipped = F.transform(rows, lambda x: T.bytes_between(x, F.when(F.octet_length(x) <= low, F.lit(0)).otherwise(low), high))
        rows = F.when(F.contains("span", F.lit("\n")), rows).otherwise(clipped)
    return F.array_join(rows, "\n")


def around(spec: str) -> Column:
    """The text around a match, by context_spec."""
    mode, before, after, up, down = context_spec(spec)
    if mode == "cols":
        return T.bytes_between(F.col("raw"), F.col("bstart") - before, F.col("bend") + after).alias("match_context")
    return box(before, after, up, down).alias("match_context")
