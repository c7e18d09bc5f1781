import io
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from keyhound.operators import report, scan
from keyhound.plans import rules
from keyhound.sources import files

PATCH = """commit 0123456789abcdef0123456789abcdef01234567
Author: A B <a@b.example>
Date:   2024-01-02

    a message

diff --git a/x.txt b/x.txt
--- a/x.txt
+++ b/x.txt
@@ -1,0 +5,2 @@
+one
+two
@@ -9 +12 @@
-old
+three
"""


def test_patches_give_added_lines_by_hunk():
    got = list(files.parse_patch(PATCH))
    assert [(raw, line) for raw, line, _ in got] == [("one\ntwo\n", 5), ("three\n", 12)]
    assert got[0][2] == {"git.sha": "0123456789abcdef0123456789abcdef01234567", "git.author_name": "A B", "git.author_email": "a@b.example", "git.date": "2024-01-02", "git.message": "a message", "path": "x.txt"}


def test_archives_open_to_a_depth():
    inner = io.BytesIO()
    with tarfile.open(fileobj=inner, mode="w:gz") as t:
        i = tarfile.TarInfo("d/e.txt")
        i.size = 2
        t.addfile(i, io.BytesIO(b"hi"))
    outer = io.BytesIO()
    with zipfile.ZipFile(outer, "w") as z:
        z.writestr("b.tgz", inner.getvalue())
    assert list(files.unpack("a.zip", outer.getvalue())) == [("a.zip!b.tgz!d/e.txt", b"hi")]
    assert [n for n, _ in files.unpack("a.zip", outer.getvalue(), 1)] == ["a.zip!b.tgz"]


def test_chunks_end_at_blank_lines_and_lose_nothing():
    text = ("é" * 30 + "\n\n") * 50
    got = list(files.chunks(text.encode(), 100, 80))
    assert b"".join(c for _, c in got).decode() == text
    assert all(c.endswith(b"\n\n") for _, c in got)
    assert [n for n, _ in got] == [sum(c.count(b"\n") for _, c in got[:i]) for i in range(len(got))]


def test_files_are_read_and_scanned(spark, tmp_path):
    (tmp_path / "a.txt").write_text('x\nkey = "ab"\n')
    (tmp_path / "b.bin").write_bytes(b"\x00\x01key = \"ab\"")
    (tmp_path / "empty").write_text("")
    f = files.file_fragments(files.read_files(spark, [str(tmp_path), str(tmp_path / "a.txt")], 'attributes["path"] endsWith ".md"'))
    found = scan.findings(f, rules.parse("[[rules]]\nid='t'\nregex='key'"))
    assert [(r.start_line, r.attributes["path"].endswith("a.txt")) for r in found.collect()] == [(2, True)]
    assert "".join(report.json_report(found)).count('"RuleID": "t"') == 1
    assert 'failures="1"' in "".join(report.junit_report(found))
    assert '"ruleId": "t"' in "".join(report.sarif_report(found, rules.parse("[[rules]]\nid='t'\nregex='key'")))
    assert "".join(report.json_report(found.limit(0))) == "[]\n"


def test_attributes_fill_and_override(spark):
    df = spark.range(1).withColumn("attributes", F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit(""), F.lit("resource"), F.lit("old")))
    got = files.with_attributes(df, {"a": "2", "b": "3", "resource": "new"}).first().attributes
    assert got == {"a": "1", "b": "3", "resource": "new"}


def test_paths_kinds_and_remotes(spark):
    assert files.not_nested(["/a/b", "/a", "/ab"]) == ["/a", "/ab"]
    assert report.kind_of("x.sarif") == "sarif"
    got = spark.createDataFrame([("git@github.com:a/b.git",), ("https://u:p@gitlab.com/a/b.git",)], "r string").select(files.web_remote(F.col("r"))).collect()
    assert [r[0] for r in got] == ["https://github.com/a/b", "https://gitlab.com/a/b"]


def test_broken_archives_do_not_stop_a_scan():
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("a.txt", "one")
        z.writestr("b.gz", b"\x1f\x8bnot a stream")
        z.writestr("c.txt", "three")
    assert list(files.unpack("z", b.getvalue())) == [("z!a.txt", b"one"), ("z!c.txt", b"three")]
    spoilt = b.getvalue().replace(b"three", b"tHree")  # the checksum fails
    assert list(files.unpack("z", spoilt)) == [("z!a.txt", b"one")]
    assert list(files.unpack("z", b"PK\x03\x04 no archive")) == [("z", b"PK\x03\x04 no archive")]
    if files.zstandard:
        assert list(files.unpack("z", files.zstandard.compress(b"text"))) == [("z", b"text")]


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("s3://b/p/q", ("b", "p/q", None)),
        ("s3://b-*", ("b-*", "", None)),
        ("https://b.s3.amazonaws.com/p", ("b", "p", "https://s3.amazonaws.com")),
        ("https://a.b.s3.eu-west-1.amazonaws.com/", ("a.b", "", "https://s3.eu-west-1.amazonaws.com")),
        ("https://s3.eu-west-1.amazonaws.com/b/p", ("b", "p", "https://s3.eu-west-1.amazonaws.com")),
        ("https://acc.r2.cloudflarestorage.com/b/p", ("b", "p", "https://acc.r2.cloudflarestorage.com")),
        ("https://b.acc.r2.cloudflarestorage.com/p", ("b", "p", "https://acc.r2.cloudflarestorage.com")),
        ("http://localhost:9000/b/p/q", ("b", "p/q", "http://localhost:9000")),
    ],
)
def test_object_locations(url, want):
    got = files.object_location(url)
    assert (got["bucket"], got["prefix"], got["endpoint"]) == want


@pytest.mark.parametrize("url", ["s3:///p", "ftp://h/b", "https://*.s3.amazonaws.com/p", "https://host"])
def test_odd_object_locations_are_errors(url):
    with pytest.raises(ValueError):
        files.object_location(url)


def test_texts_for_people_templates_and_timings(spark):
    c = rules.parse("[[rules]]\nid='t'\nregex='key=(\\w+)'\n[[rules]]\nid='u'\nregex='nothing'")
    df = spark.createDataFrame([(1, "key=abc")], "fragment_id long, raw string").withColumn("start_line", F.lit(1)).withColumn("attributes", F.create_map(F.lit("path"), F.lit("a")))
    found = scan.findings(df, c)
    assert "".join(report.template_report(found, "$RuleID=$Secret $$;")) == "t=abc $;"
    assert "a:1" in "".join(report.console_report(found)) and "'ke..." in "".join(report.console_report(found, 5))
    assert {r.rule_id: r.hits for r in report.rule_timings(df, c).collect()} == {"t": 1, "u": 0}
    assert [report.exit_code(*x) for x in ((0,), (2,), (0, True), (3, False, 7))] == [0, 1, 1, 7]


def test_symbolic_links_are_left_out_or_followed(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.txt").write_text("one")
    (tmp_path / "b.txt").write_text("two")
    (tmp_path / "d" / "l.txt").symlink_to(tmp_path / "b.txt")
    (tmp_path / "d" / "loop").symlink_to(tmp_path / "d")
    seen = lambda **k: sorted((r.attributes["path"], r.attributes.get("fs.symlink"), r.raw) for r in files.file_fragments(files.read_files(spark, [str(tmp_path / "d")], **k)).collect())
    a, b, link = (str(tmp_path / x) for x in ("d/a.txt", "b.txt", "d/l.txt"))
    assert seen() == [(a, None, "one")]
    assert seen(follow_symlinks=True) == [(b, link, "two"), (a, None, "one")]
    assert seen(follow_symlinks=True, prefilter='get(attributes, "fs.symlink", "") != ""') == [(a, None, "one")]


def test_streams_unions_and_limits(spark):
    import gzip
    import io
    import zipfile

    f = files.text_fragments(spark, io.StringIO("a\n\nb\n" * 3), {"k": "v"}, size=5, ahead=4)
    assert "".join(r.raw for r in sorted(f.collect(), key=lambda r: r.start_line)) == "a\n\nb\n" * 3 and f.first().attributes == {"k": "v"}
    assert files.text_fragments(spark, "").count() == 0
    both = files.union(f, f.limit(1))
    assert {r.fragment_id.split(":")[0] for r in both.collect()} == {"0", "1"} and both.count() == f.count() + 1
    big = gzip.compress(b"0" * 5000)
    assert list(files.unpack("x", big, limit=4999)) == [] and next(files.unpack("x", big, limit=5000))[1] == b"0" * 5000
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("big", "0" * 5000)
        z.writestr("small", "1")
    assert [n for n, _ in files.unpack("z", packed.getvalue(), limit=4999)] == ["z!small"]
