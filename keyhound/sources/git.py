"""Git repositories as fragments: history by runs of commits, and differences of the working tree.

The driver asks git for the names of commits alone; runs of consecutive commits are dealt to tasks, and each task has git
print the patches of its own. So the repository has to be at the same path for all executors.
"""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .files import SCHEMA, _rows, log_options, parse_patch

#: What is left out of patches: changes of type, unmerged, unknown, broken pairs and deletions. A fixed value.
DIFF_FILTER = "tuxdb"
#: Commits whose patches one call of git prints.
RUN = 200
_OPTIONS = ("-p", "-U0", "--no-color", "--no-ext-diff", f"--diff-filter={DIFF_FILTER}", "--date=iso-strict-local")


def _git(repo: str, *args: str, stdin: str = "") -> str:
    """The output of git; it fails where git does. Times are in UTC, and no configuration of a user's is read."""
    env = os.environ | {"TZ": "UTC", "LC_ALL": "C", "GIT_CONFIG_GLOBAL": os.devnull, "GIT_CONFIG_NOSYSTEM": "1", "GIT_TERMINAL_PROMPT": "0"}
    done = subprocess.run(["git", "-c", "safe.directory=*", "-c", "core.quotePath=false", "-C", repo, *args], input=stdin.encode(), capture_output=True, env=env)
    if done.returncode:
        raise RuntimeError(f"git {args[0]}: {done.stderr.decode(errors='replace').strip()}")
    return done.stdout.decode("utf-8", "replace")


def _fragments(name: str, patch: str) -> Iterator[tuple]:
    for i, (raw, line, a) in enumerate(parse_patch(patch)):
        if "git.date" in a:
            a = a | {"git.date": a["git.date"].replace("+00:00", "Z")}
        yield f"{name}:{i}", raw, line, list(a.items())


def history(spark: SparkSession, repo: str, options: str = "", run: int = RUN) -> DataFrame:
    """The added text of every hunk of all commits, with the commits' attributes.

    options: further options of git log, as a command line has them; they choose commits and, after --, paths.
    """
    words = log_options(options)
    at = words.index("--") if "--" in words else len(words)
    chosen, paths = words[:at], words[at:]
    commits = _git(repo, "rev-list", "--full-history", *(chosen or ["--all"]), *paths).split()
    runs = [(i, commits[i : i + run]) for i in range(0, len(commits), run)]

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for own in b.column("commits").to_pylist():
                for sha in own:  # a commit's patch at a time is in memory
                    yield _rows([*_fragments(sha, _git(repo, "log", "--no-walk", *_OPTIONS, sha, *paths))])

    rows = spark.createDataFrame(runs, "run int, commits array<string>")
    return rows.repartition(max(1, len(runs)), "run").select("commits").mapInArrow(go, SCHEMA)


def working(spark: SparkSession, repo: str, staged: bool = False) -> DataFrame:
    """The added text of what is changed and not committed, or of what is staged."""
    patch = _git(repo, "diff", *_OPTIONS[:-1], *(["--staged"] if staged else []))
    rows = [(f, raw, line, dict(a)) for f, raw, line, a in _fragments("diff", patch)]
    return spark.createDataFrame(rows, SCHEMA)


def remote(repo: str) -> str:
    """The address of a repository's origin, or the empty string."""
    try:
        return _git(repo, "config", "--get", "remote.origin.url").strip()
    except RuntimeError:
        return ""
