"""Git repositories and exports of hosts."""

import subprocess

from pyspark.sql import functions as F

from keyhound.sources import exports, files, git


def run(repo, *args):
    subprocess.run(["git", "-c", "user.name=A B", "-c", "user.email=a@b.c", "-C", str(repo), *args], check=True, capture_output=True)


def test_history_and_differences_of_a_repository(spark, tmp_path):
    run(tmp_path, "init", "-q", "-b", "main")
    for i in range(5):
        (tmp_path / "a b.txt").write_text("".join(f"line {k}\n" for k in range(i + 1)))
        (tmp_path / f"f{i}.txt").write_text(f"é {i}\n")
        run(tmp_path, "add", ".")
        run(tmp_path, "commit", "-qm", f"commit {i}\n\nmore")
    for size in (1, 2, 100):
        got = git.history(spark, str(tmp_path), run=size).collect()
        seen = sorted((r.attributes["git.message"], r.attributes["path"], r.start_line, r.raw) for r in got)
        assert seen == sorted([(f"commit {i}\n\nmore", "a b.txt", i + 1, f"line {i}\n") for i in range(5)] + [(f"commit {i}\n\nmore", f"f{i}.txt", 1, f"é {i}\n") for i in range(5)])
    a = got[0].attributes
    assert (a["git.author_name"], a["git.author_email"], len(a["git.sha"])) == ("A B", "a@b.c", 40) and a["git.date"].endswith("Z")
    assert {r.attributes["path"] for r in git.history(spark, str(tmp_path), "--all -n 2 -- f3.txt 'a b.txt'").collect()} == {"f3.txt", "a b.txt"}
    (tmp_path / "f0.txt").write_text("é 0\nnew\n")
    assert [(r.attributes["path"], r.start_line, r.raw) for r in git.working(spark, str(tmp_path)).collect()] == [("f0.txt", 2, "new\n")]
    assert git.working(spark, str(tmp_path), staged=True).count() == 0
    run(tmp_path, "add", ".")
    assert git.working(spark, str(tmp_path), staged=True).count() == 1 and git.working(spark, str(tmp_path)).count() == 0
    assert git.remote(str(tmp_path)) == ""
    run(tmp_path, "remote", "add", "origin", "git@github.com:a/b.git")
    assert git.remote(str(tmp_path)) == "git@github.com:a/b.git"


def test_threads_releases_and_logs(spark):
    from datetime import datetime

    day = lambda d: datetime(2024, 1, d)
    t = spark.createDataFrame(
        [("o/r", 1, "Title", " body ", "http://h/1", day(1), [(7, "first", day(2), False), (8, "moved", day(2), True), (9, " ", day(2), None), (10, "late", day(9), None)]), ("o/r", 2, None, None, "http://h/2", day(1), None)],
        f"repo string, number long, title string, body string, url string, created timestamp, comments array<{exports.COMMENT}>",
    )
    got = {r.fragment_id: (r.raw, r.attributes["resource"], r.attributes["url"]) for r in exports.threads(t, "pull").collect()}
    assert got == {"o/r/pulls/1": ("Title\n body", "pull", "http://h/1"), "o/r/pulls/1:7": ("first", "comment", "http://h/1#note_7"), "o/r/pulls/1:10": ("late", "comment", "http://h/1#note_10")}
    assert {r.fragment_id for r in exports.threads(t, since=day(2), until=day(9)).collect()} == {"o/r/issues/1:7"}
    assert {r.fragment_id for r in exports.threads(t, prefilter='attributes["resource"] == "comment"').collect()} == {"o/r/issues/1"}
    rel = spark.createDataFrame([("o/r", "v1", [("a.txt", bytearray(b"one")), ("b.txt", None), ("big", bytearray(b"123456"))])], "repo string, tag string, assets array<struct<name:string,content:binary>>")
    assert [(r.attributes["path"], r.raw) for r in files.file_fragments(exports.release_files(rel, 5)).collect()] == [("o/r/releases/v1/a.txt", "one")]
    jobs = spark.createDataFrame([(3, "build / test", "log"), (4, "x", None)], "id long, name string, log string")
    assert [(r.path, bytes(r.content)) for r in exports.job_files(jobs).collect()] == [("ci/jobs/build_test/job_3.log", b"log")]


def test_objects_by_their_listing(spark, tmp_path):
    for name, text in (("a.txt", "one"), ("b.txt", "two"), ("c.txt", "three, long")):
        (tmp_path / name).write_text(text)
    listing = spark.createDataFrame([(str(tmp_path / n), len((tmp_path / n).read_text()), s) for n, s in (("a.txt", "STANDARD"), ("b.txt", "GLACIER"), ("c.txt", "STANDARD"))], "path string, length long, storage_class string")
    assert [r.path for r in exports.objects(spark, listing, str(tmp_path), 5).collect()] == [str(tmp_path / "a.txt")]
    assert exports.objects(spark, listing.where(F.lit(False)), str(tmp_path), 5).count() == 0
