"""Reports of findings: every field, documents as text."""

import json
import xml.etree.ElementTree as ET

from pyspark.sql import functions as F

from keyhound.operators import compose, report, scan
from keyhound.plans import rules

RULES = "[[rules]]\nid='t'\ndescription='a <key>'\nregex='''key = \"(?P<v>\\w+)\"'''\ntags=['a','b']\n[[rules.required]]\nid='u'\n[[rules]]\nid='u'\nregex='user=(\\w+)'\nskipReport=true"


def findings(spark, *texts, **more):
    attributes = {"path": "x y.txt", "git.sha": "abc", "git.author_name": "A", "git.author_email": "a@b", "git.date": "d", "git.message": "m", "fs.symlink": "link", **more}
    df = spark.createDataFrame([(i, t, 1, attributes) for i, t in enumerate(texts)], "fragment_id long, raw string, start_line int, attributes map<string,string>")
    return compose.scan(df, rules.parse(RULES), context="0C")


def test_json_has_every_field_and_omits_empty_ones(spark):
    f = findings(spark, 'user=bob\nkey = "ab"').withColumn("validation_status", F.lit("valid")).withColumn("validation_meta", F.create_map(F.lit("k"), F.lit("v")))
    (j,) = json.loads("".join(report.json_report(f, "git@github.com:o/r.git")))
    assert {k: j[k] for k in ("RuleID", "StartLine", "StartColumn", "Match", "Secret", "MatchContext", "File", "SymlinkFile", "Commit", "Author", "Tags")} == {
        "RuleID": "t", "StartLine": 2, "StartColumn": 2, "Match": 'key = "ab"', "Secret": "ab", "MatchContext": 'key = "ab"', "File": "x y.txt", "SymlinkFile": "link", "Commit": "abc", "Author": "A", "Tags": ["a", "b"],
    }
    assert j["CaptureGroups"] == {"v": "ab"} and j["Attributes"]["git.sha"] == "abc" and j["ValidationStatus"] == "valid" and j["ValidationMeta"] == {"k": "v"}
    assert j["RequiredSets"] == [{"components": [{"RuleID": "u", "StartLine": 1, "EndLine": 1, "StartColumn": 1, "EndColumn": 8, "Match": "user=bob", "Secret": "bob"}]}]
    assert j["Link"] == "https://github.com/o/r/blob/abc/x%20y.txt#L2" and j["Fingerprint"] == "abc:x y.txt:t:2"
    bare = json.loads(report.json_rows(findings(spark, 'user=bob key = "ab"')).first().json)
    assert not {"Link", "ValidationStatus", "ValidationMeta", "ValidationReason"} & set(bare)
    assert "".join(report.json_report(f.limit(0))) == "[]\n"


def test_csv_columns_and_nothing_for_nothing(spark, tmp_path):
    f = findings(spark, 'user=bob key = "ab"')
    assert report.csv_rows(f.drop("match_context")).columns == list(report.CSV)
    assert report.csv_rows(f, "https://gitlab.com/o/r").columns[-2:] == ["Link", "MatchContext"]
    assert report.write_csv(f, str(tmp_path / "a")) and not report.write_csv(f.limit(0), str(tmp_path / "b"))
    assert not (tmp_path / "b").exists()


def test_sarif_and_junit_are_read_again(spark):
    f = findings(spark, 'user=bob key = "ab"', 'key = "cd" user=<al')
    config = rules.parse(RULES)
    d = json.loads("".join(report.sarif_report(f, config)))
    one = d["runs"][0]["results"][0]
    place = one["locations"][0]["physicalLocation"]
    assert len(d["runs"][0]["results"]) == 1 and [r["id"] for r in d["runs"][0]["tool"]["driver"]["rules"]] == ["t", "u"]
    assert place["artifactLocation"]["uri"] == "link" and place["contextRegion"]["snippet"]["text"] == 'key = "ab"' and one["partialFingerprints"]["commitSha"] == "abc"
    assert json.loads("".join(report.sarif_report(f.limit(0), config)))["runs"][0]["results"] == []
    suite = ET.fromstring("".join(report.junit_report(f))).find("testsuite")
    assert suite.get("failures") == "1" and suite.find("testcase").get("classname") == "a <key>" and json.loads(suite.find("testcase/failure").text)["Secret"] == "ab"


def test_kinds_and_exit_codes():
    assert [report.kind_of(x) for x in ("a.json", "b.CSV", "c.sarif", "d.xml")] == ["json", "csv", "sarif", "junit"]
    assert (report.exit_code(0), report.exit_code(2), report.exit_code(2, code=7), report.exit_code(0, failed=True)) == (0, 1, 7, 1)


def test_timings_and_guard(spark):
    f = scan.fragments(spark.createDataFrame([(1, "user=bob"), (2, "own")], "i long, t string"), "t", "i", F.when(F.col("i") == 2, F.lit("rules.toml")).otherwise(F.lit("a")))
    config = rules.parse(RULES)
    config.path = "rules.toml"
    assert [r.fragment_id for r in scan.prefiltered(f, config).collect()] == [1]
    assert {r.rule_id: r.hits for r in report.rule_timings(f, config).collect()} == {"t": 0, "u": 1}
