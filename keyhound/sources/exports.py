"""Exports of code hosts and model hubs as fragments: threads (issues, requests, discussions), releases, job logs, objects.

Nothing here talks to a network: the tables are what a host's own export, or a crawl, has written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyhound.functions.expr import skips

from .files import in_range, read_files, skip_reason

#: A comment or event of a thread.
COMMENT = "struct<id:bigint,text:string,created:timestamp,system:boolean>"


def _attributes(**values: Column) -> Column:
    pairs = F.create_map(*[x for k, v in values.items() for x in (F.lit(k.replace("__", ".")), F.coalesce(v.cast("string"), F.lit("")))])
    return F.map_filter(pairs, lambda k, v: v != "")


def threads(df: DataFrame, kind: str = "issue", since=None, until=None, prefilter: str = "") -> DataFrame:
    """Threads (repo, number, title, body, url, created, comments array<COMMENT>) as fragments.

    Title and body are one fragment, every comment one of its own; each is taken or left by its own time. Comments that
    the host wrote itself (`system`) and texts without any character are left out.
    """
    own = df.select("repo", "number", "url", F.explode(F.concat(
        F.array(F.struct(F.lit(None).cast("bigint").alias("id"), F.concat_ws("\n", F.coalesce("title", F.lit("")), F.coalesce("body", F.lit(""))).alias("text"), F.col("created").cast("timestamp").alias("created"), F.lit(False).alias("system"))),
        F.coalesce(F.col("comments").cast(f"array<{COMMENT}>"), F.array().cast(f"array<{COMMENT}>")),
    )).alias("c"))
    text = F.btrim("c.text", F.lit(" \t\r\n\f\x0b"))
    rows = own.where(~F.coalesce("c.system", F.lit(False)) & (text != ""))
    if since is not None or until is not None:
        rows = rows.where(in_range(F.col("c.created"), since, until))
    body = F.col("c.id").isNull()
    path = F.concat("repo", F.lit(f"/{kind}s/"), F.col("number").cast("string"))
    url = F.when(body, F.col("url")).otherwise(F.concat("url", F.lit("#note_"), F.col("c.id").cast("string")))
    attributes = _attributes(path=path, url=url, resource=F.when(body, F.lit(kind)).otherwise(F.lit("comment")), thread__kind=F.lit(kind))
    out = rows.select(F.concat(path, F.when(body, F.lit("")).otherwise(F.concat(F.lit(":"), F.col("c.id").cast("string")))).alias("fragment_id"), text.alias("raw"), F.lit(1).alias("start_line"), attributes.alias("attributes"))
    return out.where(~skips(prefilter, {"attributes": F.col("attributes")})) if prefilter else out


def release_files(df: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Releases (repo, tag, assets array<struct<name, content>>) as files (path, content), for `files.file_fragments`."""
    rows = df.select("repo", "tag", F.explode("assets").alias("a")).where(F.col("a.content").isNotNull())
    if max_bytes:
        rows = rows.where(F.octet_length("a.content") <= max_bytes)
    return rows.select(F.concat("repo", F.lit("/releases/"), "tag", F.lit("/"), "a.name").alias("path"), F.col("a.content").alias("content"))


def job_files(df: DataFrame) -> DataFrame:
    """Job logs (id, name, log) as files (path, content); a name's characters that paths can't have become underscores."""
    safe = F.regexp_replace("name", r"[^0-9A-Za-z._-]+", "_")
    path = F.concat(F.lit("ci/jobs/"), safe, F.lit("/job_"), F.col("id").cast("string"), F.lit(".log"))
    return df.where(F.col("log").isNotNull()).select(path.alias("path"), F.col("log").cast("binary").alias("content"))


def objects(spark: SparkSession, listing: DataFrame, prefix: str, max_bytes: int, prefilter: str = "") -> DataFrame:
    """The objects below a prefix that the store's listing (path, length, storage_class) doesn't rule out, as files."""
    kept = listing.where(skip_reason(F.col("path"), F.col("length"), F.col("storage_class"), max_bytes) == "").select(F.col("path").alias("listed"))
    found = read_files(spark, [prefix], prefilter, max_bytes)
    return found.join(kept, F.col("path") == F.col("listed"), "left_semi")
