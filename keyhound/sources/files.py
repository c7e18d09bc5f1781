"""Sources of fragments: files, archives, chunks of long texts, patches; filters on what they come from."""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import os
import re
import shlex
import tarfile
import zipfile
import zlib
from collections.abc import Iterator
from functools import reduce
from typing import BinaryIO, TextIO
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyhound.functions.dialect import glob
from keyhound.functions.expr import skips

try:
    import zstandard
except ImportError:
    zstandard = None

CHUNK, LOOK_AHEAD = 100_000, 25_000
ARCHIVE_DEPTH = 8
#: Files, and files within archives, of more bytes aren't read, unless a caller says otherwise.
MAX_BYTES = 250 << 20
#: What broken archives raise.
_BROKEN = (OSError, EOFError, lzma.LZMAError, zlib.error, zipfile.BadZipFile, tarfile.TarError, NotImplementedError, RuntimeError, ValueError, *([zstandard.ZstdError] if zstandard else []))
#: Storage classes that can't be read at once. Fixed values.
ARCHIVED = ("GLACIER", "GLACIER_IR", "DEEP_ARCHIVE")
SCHEMA = "fragment_id string, raw string, start_line int, attributes map<string,string>"


def not_nested(paths: list[str]) -> list[str]:
    """Paths that aren't inside another of the paths."""
    clean = sorted({p.rstrip("/") or "/" for p in paths})
    return [p for p in clean if not any(p != q and p.startswith(q.rstrip("/") + "/") for q in clean)]


def links(paths: list[str]) -> tuple[dict[str, str], dict[str, str]]:
    """Symbolic links to files and to folders below local paths, each with what it leads to. Only names are read."""
    to_files: dict[str, str] = {}
    to_folders: dict[str, str] = {}
    todo = [p for p in paths if "://" not in p]
    while todo:
        at = todo.pop()
        if os.path.islink(at):
            (to_folders if os.path.isdir(at) else to_files)[at] = os.path.realpath(at)
        elif os.path.isdir(at):
            todo += [e.path for e in os.scandir(at)]
    return to_files, to_folders


def read_files(spark: SparkSession, paths: list[str], prefilter: str = "", max_bytes: int | None = MAX_BYTES, pattern: str = "*", follow_symlinks: bool = False) -> DataFrame:
    """Files as rows (path, length, content, symlink). Size and prefilter are tested before any content is read.

    Local symbolic links are left out, or followed: then `path` is what a link leads to and `symlink` the link; a folder
    that a link leads to is read once, as itself.
    """
    to_files, to_folders = links(paths)
    more = [t for t in to_folders.values() if follow_symlinks]
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(not_nested([*paths, *more]))
    df = df.withColumn("path", F.regexp_replace("path", "^file:/+", "/")).where(F.col("length") > 0)
    for folder in to_folders:  # names of links, as many as there are
        df = df.where(~F.startswith("path", F.lit(folder.rstrip("/") + "/")))
    if max_bytes:
        df = df.where(F.col("length") <= max_bytes)
    known = spark.createDataFrame([*to_files.items()], "link string, target string")
    df = df.join(F.broadcast(known), F.col("path") == F.col("link"), "left")
    if not follow_symlinks:
        df = df.where(F.col("link").isNull())
    df = df.withColumn("path", F.coalesce("target", "path")).withColumn("symlink", F.coalesce("link", F.lit("")))
    if prefilter:
        df = df.where(~skips(prefilter, {"attributes": F.create_map(F.lit("path"), F.col("path"), F.lit("fs.symlink"), F.col("symlink"))}))
    return df.select("path", "length", "content", "symlink")


def text_fragments(spark: SparkSession, text: str | TextIO, attributes: dict[str, str] | None = None, size: int = CHUNK, ahead: int = LOOK_AHEAD) -> DataFrame:
    """A text, or what a stream (standard input) still holds, as fragments with attributes."""
    whole = (text if isinstance(text, str) else text.read()).encode("utf-8", "surrogatepass")
    rows = [(f"text:{line + 1}", chunk.decode("utf-8", "replace"), line + 1, dict(attributes or {})) for line, chunk in chunks(whole, size, ahead)]
    return spark.createDataFrame(rows, SCHEMA)


def union(*sources: DataFrame) -> DataFrame:
    """Fragments of several sources as one table; ids of the n-th source begin with n and a colon."""
    own = [d.select(F.concat(F.lit(f"{i}:"), F.col("fragment_id").cast("string")).alias("fragment_id"), "raw", "start_line", "attributes") for i, d in enumerate(sources)]
    return reduce(DataFrame.unionByName, own)


def _unzst(data: BinaryIO):
    return zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True)


def _members(name: str, data: bytes, limit: int = MAX_BYTES) -> Iterator[tuple[str, bytes]] | None:
    """The files of an archive or the content of a compressed stream; None for anything else. No file is read beyond `limit`."""
    if zipfile.is_zipfile(io.BytesIO(data)):
        z = zipfile.ZipFile(io.BytesIO(data))
        return ((f"{name}!{i.filename}", z.read(i)) for i in z.infolist() if not i.is_dir() and not i.flag_bits & 1 and i.file_size <= limit)
    for magic, opened in ((b"\x1f\x8b", gzip.GzipFile), (b"BZh", bz2.BZ2File), (b"\xfd7zXZ\x00", lzma.LZMAFile), (b"\x28\xb5\x2f\xfd", _unzst)):
        if data.startswith(magic) and not (opened is _unzst and zstandard is None):
            with opened(fileobj=io.BytesIO(data)) if opened is gzip.GzipFile else opened(io.BytesIO(data)) as f:
                inner = f.read(limit + 1)
            return iter([(name, inner)] if len(inner) <= limit else [])
    if data[257:262] == b"ustar":
        t = tarfile.open(fileobj=io.BytesIO(data))
        return ((f"{name}!{i.name}", t.extractfile(i).read()) for i in t if i.isfile() and i.size <= limit)
    return None


def unpack(name: str, data: bytes, depth: int = ARCHIVE_DEPTH, limit: int = MAX_BYTES) -> Iterator[tuple[str, bytes]]:
    """A file, or the files of an archive by names joined with !; single compressed streams are opened in place.

    A broken archive gives the files before its first fault; encrypted files, and files of over `limit` bytes, are left out.
    """
    if depth > 0:
        try:
            inner = _members(name, data, limit)
        except _BROKEN:
            return
        if inner is not None:
            while True:
                try:
                    below, content = next(inner)
                except StopIteration:
                    return
                except _BROKEN:
                    return
                yield from unpack(below, content, depth - 1, limit)
    yield name, data


def binary(data: bytes) -> bool:
    """Whether a file is taken for something else than text: a NUL or a known beginning, before any newline."""
    head = data[:512].split(b"\n", 1)[0]
    return b"\0" in head or head.startswith((b"%PDF-", b"\x7fELF", b"\x89PNG", b"\xff\xd8\xff", b"GIF8", b"MZ\x90"))


def chunks(text: bytes, size: int = CHUNK, ahead: int = LOOK_AHEAD) -> Iterator[tuple[int, bytes]]:
    """(newlines before, chunk) of a text: about `size` bytes, and on to a blank line no more than `ahead` further."""
    at = lines = 0
    while at < len(text):
        end = min(at + size, len(text))
        if end < len(text):
            m = re.compile(rb"\n[ \t\r\f\v]*\n").search(text, max(at, end - 2), min(len(text), end + ahead))
            end = m.end() if m else min(len(text), end + ahead)
            while end < len(text) and text[end] & 0xC0 == 0x80:
                end += 1
        yield lines, text[at:end]
        lines += text.count(b"\n", at, end)
        at = end


def file_fragments(files: DataFrame, archive_depth: int = ARCHIVE_DEPTH, size: int = CHUNK, ahead: int = LOOK_AHEAD) -> DataFrame:
    """Files (path, content) as fragments: archives opened, binary files left out, long texts in chunks."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, content, link in zip(*(b.column(c).to_pylist() for c in ("path", "content", "symlink")), strict=True):
                more = [("fs.symlink", link)] if link else []
                for name, data in unpack(path, content or b"", archive_depth):
                    if not data or binary(data):
                        continue
                    for line, chunk in chunks(data, size, ahead):
                        rows.append((f"{name}:{line + 1}", chunk.decode("utf-8", "replace"), line + 1, [("path", name), *more]))
            yield _rows(rows)

    link = F.col("symlink") if "symlink" in files.columns else F.lit("")
    return files.select("path", "content", link.alias("symlink")).mapInArrow(go, SCHEMA)


def archived(fragments: DataFrame) -> DataFrame:
    """Fragments as files (path, content), each a zip with a compressed tar with the text; what file_fragments() undoes."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for f, raw in zip(b.column("f").to_pylist(), b.column("raw").to_pylist(), strict=True):
                data, tar, packed = (raw or "").encode("utf-8", "surrogatepass"), io.BytesIO(), io.BytesIO()
                with tarfile.open(fileobj=tar, mode="w", format=tarfile.USTAR_FORMAT) as t:
                    info = tarfile.TarInfo(f"{f}.txt")
                    info.size = len(data)
                    t.addfile(info, io.BytesIO(data))
                with zipfile.ZipFile(packed, "w") as z:
                    z.writestr(zipfile.ZipInfo(f"in/{f}.tar"), gzip.compress(tar.getvalue(), mtime=0))
                out.append(packed.getvalue())
            yield pa.RecordBatch.from_arrays([pa.array([f"{f}.zip" for f in b.column("f").to_pylist()], pa.string()), pa.array(out, pa.binary())], ["path", "content"])

    return fragments.select(F.col("fragment_id").cast("string").alias("f"), "raw").mapInArrow(go, "path string, content binary")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
    types = [pa.string(), pa.string(), pa.int32(), pa.map_(pa.string(), pa.string())]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["fragment_id", "raw", "start_line", "attributes"])


def chunked(df: DataFrame, size: int = CHUNK, ahead: int = LOOK_AHEAD) -> DataFrame:
    """Fragments with long texts in chunks; start_line follows."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for f, raw, line, attributes in zip(*(b.column(c).to_pylist() for c in ("fragment_id", "raw", "start_line", "attributes")), strict=True):
                for before, chunk in chunks((raw or "").encode("utf-8", "surrogatepass"), size, ahead):
                    rows.append((f, chunk.decode("utf-8", "replace"), line + before, attributes))
            yield _rows(rows)

    picked = df.select(F.col("fragment_id").cast("string").alias("fragment_id"), "raw", "start_line", "attributes")
    return picked.mapInArrow(go, SCHEMA)


_COMMIT = re.compile(r"^commit ([0-9a-f]{7,64})", re.M)
_HUNK = re.compile(r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,\d+)? @@")


def parse_patch(text: str) -> Iterator[tuple[str, int, dict[str, str]]]:
    """(added text, first line, attributes) of each hunk of `git log -p` or `git diff` output."""
    attributes: dict[str, str] = {}
    path, start, added, message = "", 0, [], []
    in_header = False

    def flush():
        if added and path:
            yield "\n".join(added) + "\n", start, {**attributes, **({"git.message": "\n".join(message).strip()} if message else {}), "path": path}

    for line in text.split("\n"):
        if m := _COMMIT.match(line):
            yield from flush()
            attributes, path, added, message, in_header = {"git.sha": m[1]}, "", [], [], True
        elif in_header and line.startswith("Author: "):
            m = re.match(r"Author:\s*(.*?)\s*<([^>]*)>", line)
            if m:
                attributes |= {"git.author_name": m[1], "git.author_email": m[2]}
        elif in_header and line.startswith("Date: "):
            attributes["git.date"] = line[5:].strip()
        elif in_header and line.startswith("    "):
            message.append(line[4:])
        elif line.startswith("diff --git "):
            yield from flush()
            path, added, in_header = "", [], False
        elif not added and line.startswith("+++ ") and not in_header and path == "":
            path = "" if line[4:] == "/dev/null" else re.sub(r"^b/", "", line[4:].split("\t")[0].strip('"'))
        elif m := _HUNK.match(line):
            yield from flush()
            start, added = int(m[1]), []
        elif line.startswith("+") and path:
            added.append(line[1:])
    yield from flush()


def patch_fragments(patches: DataFrame, column: str = "patch", fragment_id: str = "patch_id") -> DataFrame:
    """Rows of patch text as fragments of added lines, with their commits' attributes."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for f, text in zip(b.column("f").to_pylist(), b.column("t").to_pylist(), strict=True):
                rows += [(f"{f}:{i}", raw, line, list(a.items())) for i, (raw, line, a) in enumerate(parse_patch(text or ""))]
            yield _rows(rows)

    return patches.select(F.col(fragment_id).cast("string").alias("f"), F.col(column).alias("t")).mapInArrow(go, SCHEMA)


def log_options(text: str) -> list[str]:
    """Words of a string of git options, quotes and escapes as a shell takes them, with nothing run."""
    return shlex.split(text)


def with_attributes(df: DataFrame, values: dict[str, str], override: tuple[str, ...] = ("resource",)) -> DataFrame:
    """Adds attributes: those of `override` replace what is there, others only fill what is missing or empty."""
    if not values:
        return df
    new = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    there = F.map_filter("attributes", lambda k, v: v != "")
    fill = F.map_filter(new, lambda k, v: k.isin(*override) | ~F.map_contains_key(there, k))
    return df.withColumn("attributes", F.map_concat(F.map_filter("attributes", lambda k, v: ~F.map_contains_key(fill, k)), fill))


def in_range(ts: Column, since=None, until=None) -> Column:
    """since <= ts < until, each where given."""
    out = F.lit(True)
    if since is not None:
        out = out & (ts >= F.lit(since))
    return out & (ts < F.lit(until)) if until is not None else out


def excluded(name: Column, patterns: list[str], lower: bool = False) -> Column:
    """Whether a name matches one of the shell patterns."""
    out = F.lit(False)
    for p in patterns:
        out = out | F.rlike(F.lower(name) if lower else name, F.lit(glob(p.lower() if lower else p)))
    return out


def skip_reason(path: Column, length: Column, storage_class: Column, max_bytes: int) -> Column:
    """Why an object of a store isn't read, or the empty string; objects are rows with a path, a length and a class."""
    return (
        F.when(storage_class.isin(*ARCHIVED), F.concat(F.lit("storage_class:"), storage_class))
        .when(length > max_bytes, F.lit("size_limit"))
        .when(length == 0, F.lit("empty"))
        .when(F.endswith(path, F.lit("/")), F.lit("directory"))
        .otherwise(F.lit(""))
    )


def object_location(url: str) -> dict:
    """bucket (a shell pattern may stand for several), prefix, endpoint (None: the default) and path for Spark of an object URL.

    Forms: s3://bucket/prefix; hosts that name the bucket; hosts with the bucket as the first part of the path.
    """
    u = urlsplit(url)
    host, path, endpoint = (u.hostname or ""), u.path.lstrip("/"), None
    if u.scheme == "s3":
        bucket, prefix = u.netloc, path
    elif u.scheme in ("http", "https"):
        if any(c in host for c in "*?["):
            raise ValueError("a pattern can only stand for the bucket, not for the host")
        named = re.fullmatch(r"(?:(?P<bucket>.+)\.)?(?P<store>s3(?:[.-][a-z0-9-]+)?\.amazonaws\.com|[0-9a-z]+\.r2\.cloudflarestorage\.com)", host)
        if named and named["bucket"]:
            bucket, prefix = named["bucket"], path
        else:
            bucket, _, prefix = path.partition("/")
        endpoint = f"{u.scheme}://{named['store'] if named else u.netloc}"
    else:
        raise ValueError(f"no object store of scheme {u.scheme!r}")
    if not bucket:
        raise ValueError(f"{url}: no bucket")
    return {"bucket": bucket, "prefix": prefix, "endpoint": endpoint, "path": f"s3a://{bucket}/{prefix}"}


def web_remote(remote: Column) -> Column:
    """A remote's address on the web: ssh forms as https, without user, password and .git."""
    https = F.regexp_replace(F.regexp_replace(remote, r"^(?:ssh://)?git@([^:/]+)[:/](?:\d+/)?", "https://$1/"), r"^(https?://)[^/@]*@", "$1")
    return F.regexp_replace(https, r"\.git/?$", "")


def platform(remote: Column) -> Column:
    """The platform that a host is known for."""
    host = F.lower(F.regexp_extract(remote, r"^https?://([^/:]+)", 1))
    known = {"github.com": "github", "gitlab.com": "gitlab", "dev.azure.com": "azure", "bitbucket.org": "bitbucket", "gitea.com": "gitea", "codeberg.org": "gitea"}
    out = F.lit("unknown")
    for h, p in known.items():
        out = F.when(host == h, F.lit(p)).otherwise(out)
    return out
