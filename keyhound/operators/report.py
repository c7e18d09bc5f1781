"""Reports of findings: rows for JSON and CSV, SARIF and JUnit documents.

Rows are written by Spark, in as many files as there are tasks. The single documents (a JSON array, SARIF, JUnit)
are generators of text that read a partition at a time through the driver and hold no list of findings.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from string import Template
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyhound.functions import text as T
from keyhound.sources.files import platform, web_remote

#: Columns of the CSV report, in order. Fixed values.
CSV = ("RuleID", "Commit", "File", "SymlinkFile", "Secret", "Match", "StartLine", "EndLine", "StartColumn", "EndColumn", "Author", "Message", "Date", "Email", "Fingerprint", "Tags")


_JSON = ("RuleID", "Description", "StartLine", "EndLine", "StartColumn", "EndColumn", "Match", "Secret", "MatchContext", "CaptureGroups", "Attributes", "RequiredSets", "ValidationStatus", "ValidationReason", "ValidationMeta", "File", "SymlinkFile", "Commit", "Link", "Entropy", "Author", "Email", "Date", "Message")
#: Fields that JSON leaves out where they are empty.
_OMITTED = ("MatchContext", "CaptureGroups", "Attributes", "RequiredSets", "ValidationStatus", "ValidationReason", "ValidationMeta", "Link")


def _sets(c: Column) -> Column:
    """Required sets by the names of reports."""
    part = lambda x: F.struct(
        x["rule_id"].alias("RuleID"), x["start_line"].alias("StartLine"), x["end_line"].alias("EndLine"), x["start_column"].alias("StartColumn"), x["end_column"].alias("EndColumn"), x["match"].alias("Match"), x["secret"].alias("Secret"),
        F.when(F.size(x["capture_groups"]) > 0, F.map_from_entries(x["capture_groups"])).alias("CaptureGroups"),
    )
    some = lambda x: F.nullif(x, F.lit(""))
    return F.transform(c, lambda s: F.struct(F.transform(s["components"], part).alias("components"), some(s["validation_status"]).alias("validationStatus"), some(s["validation_reason"]).alias("validationReason")))


def flat(found: DataFrame, remote: str = "") -> DataFrame:
    """Findings with the columns of reports; file and commit are taken from the attributes. remote: what links lead to."""
    of = lambda a: F.coalesce(F.try_element_at("attributes", F.lit(a)), F.lit(""))
    has = lambda c, kind="string": F.col(c) if c in found.columns else F.lit(None).cast(kind)
    text = lambda c: F.coalesce(has(c), F.lit(""))
    web = web_remote(F.lit(remote))
    link = F.when(of("git.sha") == "", F.lit("")).otherwise(T.scm_link(platform(web), web, of("git.sha"), of("path"), F.col("start_line"), F.col("end_line")))
    sets = _sets(F.col("required_sets")) if "required_sets" in found.columns else F.lit(None).cast("array<string>")
    meta = dict(found.dtypes).get("validation_meta", "map<string,string>")
    return found.select(
        F.col("rule_id").alias("RuleID"), F.col("description").alias("Description"), of("git.sha").alias("Commit"), of("path").alias("File"), of("fs.symlink").alias("SymlinkFile"), F.col("secret").alias("Secret"), F.col("match").alias("Match"),
        F.col("start_line").alias("StartLine"), F.col("end_line").alias("EndLine"), F.col("start_column").alias("StartColumn"), F.col("end_column").alias("EndColumn"), of("git.author_name").alias("Author"), of("git.message").alias("Message"),
        of("git.date").alias("Date"), of("git.author_email").alias("Email"), F.col("fingerprint").alias("Fingerprint"), F.col("tags").alias("TagList"), F.array_join("tags", " ").alias("Tags"), F.col("entropy").alias("Entropy"), F.col("attributes").alias("Attributes"),
        (link if remote else F.lit("")).alias("Link"), text("match_context").alias("MatchContext"), F.col("capture_groups").alias("CaptureGroups"), sets.alias("RequiredSets"),
        text("validation_status").alias("ValidationStatus"), text("validation_reason").alias("ValidationReason"), has("validation_meta", meta).alias("ValidationMeta"),
    )


def csv_rows(found: DataFrame, remote: str = "") -> DataFrame:
    """The columns of CSV; Link where there is a remote, MatchContext where findings have one."""
    more = ["Link"] * bool(remote) + ["MatchContext"] * ("match_context" in found.columns)
    return flat(found, remote).select(*CSV, *more)


def write_csv(found: DataFrame, path: str, remote: str = "") -> bool:
    """Writes the rows, or nothing at all where there are none."""
    rows = csv_rows(found, remote)
    if rows.isEmpty():
        return False
    rows.write.option("header", True).option("escape", '"').csv(path)
    return True


def json_rows(found: DataFrame, remote: str = "") -> DataFrame:
    """One JSON object a finding, in a column `json`."""
    f = flat(found, remote)
    kinds = dict(f.dtypes)
    empty = lambda c: F.col(c) == "" if kinds[c] == "string" else F.size(c) <= 0
    shown = [F.when(~empty(c), F.col(c)).alias(c) if c in _OMITTED else F.col(c) for c in _JSON]
    return f.select(F.to_json(F.struct(*shown, F.col("TagList").alias("Tags"), "Fingerprint")).alias("json"))


def json_report(found: DataFrame, remote: str = "") -> Iterator[str]:
    first = True
    yield "["
    for row in json_rows(found, remote).toLocalIterator():
        body = json.dumps(json.loads(row.json), indent=1, ensure_ascii=False).replace("\n", "\n ")
        yield ("\n " if first else ",\n ") + body
        first = False
    yield "]\n" if first else "\n]\n"


def _said(r) -> str:
    return f"Rule {r.RuleID} found a secret in {r.File}, line {r.StartLine}" + (f" (commit {r.Commit})" if r.Commit else "")


def sarif_report(found: DataFrame, config, tool: str = "keyhound") -> Iterator[str]:
    """A SARIF 2.1.0 document; rules come from the configuration."""
    rules = [{"id": r.id, "shortDescription": {"text": r.description}} for r in config.rules.values()]
    head = {"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [{"tool": {"driver": {"name": tool, "semanticVersion": "1.0.0", "rules": rules}}, "results": []}]}
    yield json.dumps(head, ensure_ascii=False)[: -len("]}]}")]
    first = True
    for r in flat(found).toLocalIterator():
        region = {"startLine": r.StartLine, "startColumn": r.StartColumn, "endLine": r.EndLine, "endColumn": r.EndColumn, "snippet": {"text": r.Secret}}
        place = {"artifactLocation": {"uri": r.SymlinkFile or r.File}, "region": region}
        if r.MatchContext:
            place["contextRegion"] = {"startLine": r.StartLine, "endLine": r.EndLine, "snippet": {"text": r.MatchContext}}
        result = {
            "message": {"text": _said(r)},
            "ruleId": r.RuleID,
            "locations": [{"physicalLocation": place}],
            "partialFingerprints": {"commitSha": r.Commit, "email": r.Email, "author": r.Author, "date": r.Date, "commitMessage": r.Message},
            "properties": {"tags": r.TagList},
        }
        yield ("" if first else ", ") + json.dumps(result, ensure_ascii=False)
        first = False
    yield "]}]}\n"


def junit_report(found: DataFrame, tool: str = "keyhound") -> Iterator[str]:
    """A JUnit document: a failing case for each finding. The findings are counted before they are read."""
    n = found.count()
    yield f'<?xml version="1.0" encoding="UTF-8"?>\n<testsuites>\n  <testsuite failures="{n}" name="{tool}" tests="{n}" time="">\n'
    for r in flat(found).toLocalIterator():
        said = _said(r)
        body = json.dumps({"RuleID": r.RuleID, "StartLine": r.StartLine, "Match": r.Match, "Secret": r.Secret, "File": r.File, "Fingerprint": r.Fingerprint}, indent=1, ensure_ascii=False)
        yield f"    <testcase classname={quoteattr(r.Description)} file={quoteattr(r.File)} name={quoteattr(said)}>\n      <failure message={quoteattr(said)} type={quoteattr(r.Description)}>{escape(body)}</failure>\n    </testcase>\n"
    yield "  </testsuite>\n</testsuites>\n"


def template_report(found: DataFrame, template: str) -> Iterator[str]:
    """The template once a finding, with $RuleID and the other columns of reports in it."""
    t = Template(template)
    for r in flat(found).toLocalIterator():
        yield t.substitute(r.asDict())


def console_report(found: DataFrame, width: int = 120) -> Iterator[str]:
    """A block of lines a finding, for reading; long matches are cut at `width`."""
    for r in flat(found).toLocalIterator():
        shown = r.Match if len(r.Match) <= width else r.Match[: width - 3] + "..."
        place = f"{r.File}:{r.StartLine}" if r.File else f"line {r.StartLine}"
        yield f"{r.RuleID}  {place}\n  {shown!r}\n  entropy {r.Entropy:.2f}" + (f"  tags {r.Tags}" if r.Tags else "") + f"\n  {r.Fingerprint}\n"


def rule_timings(fragments: DataFrame, config) -> DataFrame:
    """A diagnosis: the seconds and hits of each rule that is run alone, slowest first (a scan runs all rules at once)."""
    from .scan import findings

    rows = []
    for r in config.rules.values():
        began = time.perf_counter_ns()
        hits = findings(fragments, config.only([r.id])).where(F.col("rule_id") == r.id).count()
        total = time.perf_counter_ns() - began
        rows.append((r.id, total, hits, total // max(1, hits)))
    rows.sort(key=lambda x: (-x[1], -x[2], x[0]))
    return fragments.sparkSession.createDataFrame(rows, "rule_id string, total_duration_ns bigint, hits bigint, avg_duration_ns bigint")


def exit_code(findings: int, failed: bool = False, code: int = 1) -> int:
    """A command's exit code: 1 on failure, `code` where there are findings, else 0."""
    return 1 if failed else code if findings else 0


def kind_of(path: str) -> str:
    """The report's kind by its file's ending."""
    ending = path.rsplit(".", 1)[-1].lower() if "." in path else ""
    kinds = {"json": "json", "csv": "csv", "sarif": "sarif", "xml": "junit"}
    if ending not in kinds:
        raise ValueError(f"no report of kind {ending!r}")
    return kinds[ending]
