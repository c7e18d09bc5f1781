"""Token-id files: whole documents' ids in ascending doc_id order, coded by Simple-8b.

The format is a Parquet table (so any file system that Spark writes will do, and lost tasks are written anew by
Spark's committer) whose rows are segments: some consecutive documents of one part of the id range.

    part int, segment int     where the segment stands: by part, then by segment
    first_doc bigint          its first doc_id
    doc_ids array<bigint>, n_tokens array<int>   its documents and their numbers of ids
    n_ids bigint              their sum
    ids_before bigint         the ids of the part's segments before it
    block_offsets binary      little-endian uint32: the first word of each block of 256 ids
    words binary              little-endian uint64 Simple-8b words

Documents are range-partitioned once by (doc_id, hash of the text) and encoded where they are sorted; the texts
cross the network once and the ids never do. A document's `start` is its segment's `ids_before` and the sum over
the parts before; of that there is one number for each writing task, which is what is broadcast.

Defined cases: null and empty texts have the end id alone; null doc_ids come first; repeated doc_ids stay, in the
order of their texts' hash and text; an empty table gives an empty file and no rows.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import simple8b
from .common import checkpoint_dir, table
from .tokens import encoding, slices, vocabulary_path

END_ID = 0
#: Ids in a segment, more only where one document alone has more.
SEGMENT_IDS = 1 << 19
SCHEMA = (
    "part int, segment int, first_doc bigint, doc_ids array<bigint>, n_tokens array<int>, n_ids bigint, "
    "ids_before bigint, block_offsets binary, words binary"
)
_ARROW = pa.schema(
    [
        ("part", pa.int32()), ("segment", pa.int32()), ("first_doc", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
        ("n_tokens", pa.list_(pa.int32())), ("n_ids", pa.int64()), ("ids_before", pa.int64()), ("block_offsets", pa.binary()), ("words", pa.binary()),
    ]
)


def _segment(part: int, segment: int, before: int, docs: list[int | None], ids: list[np.ndarray]) -> pa.RecordBatch:
    flat = np.concatenate(ids)
    words, offsets = simple8b.encode(flat)
    row = (part, segment, docs[0], docs, [len(x) for x in ids], len(flat), before, offsets.astype("<u4").tobytes(), words.astype("<u8").tobytes())
    return pa.RecordBatch.from_arrays([pa.array([v], t.type) for v, t in zip(row, _ARROW, strict=True)], schema=_ARROW)


def segments(docs: DataFrame, vocabulary: str | None = None, end_id: int = END_ID, segment_ids: int = SEGMENT_IDS, parts: int | None = None) -> DataFrame:
    """docs (doc_id, text) as rows of the file format."""
    path = vocabulary or vocabulary_path()

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, segment, before, open_docs, open_ids, size = TaskContext.get().partitionId(), 0, 0, [], [], 0
        encoder = encoding(path)
        for piece in (x for b in batches for x in slices(b)):
            ids, bounds = encoder.encode(piece.column("text"))
            for k, doc_id in enumerate(piece.column("doc_id").to_pylist()):
                own = np.append(ids[bounds[k] : bounds[k + 1]], np.uint32(end_id))
                if open_docs and size + len(own) > segment_ids:
                    yield _segment(part, segment, before, open_docs, open_ids)
                    segment, before, open_docs, open_ids, size = segment + 1, before + size, [], [], 0
                open_docs.append(doc_id)
                open_ids.append(own)
                size += len(own)
        if open_docs:
            yield _segment(part, segment, before, open_docs, open_ids)

    picked = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = picked.withColumn("h", F.xxhash64("text")).repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h", "text")
    return keyed.select("doc_id", "text").mapInArrow(go, SCHEMA)


def write(docs: DataFrame, path: str, **options) -> None:
    segments(docs, **options).write.option("compression", "zstd").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The segments with their bases: the number of ids in all segments before."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    totals = rows.groupBy("part").agg(F.sum("n_ids").alias("total"))
    # A row for each writing task: few enough for one task's window and for every executor's memory.
    bases = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("part_base"))
    return rows.join(F.broadcast(bases), "part").withColumn("base", F.col("part_base") + F.col("ids_before")).drop("part_base")


def decoded(row: dict) -> list[np.ndarray]:
    """The ids of each document of a segment, all of its blocks decoded at once from their offsets."""
    flat = simple8b.decode_blocks(np.frombuffer(row["words"], "<u8"), np.frombuffer(row["block_offsets"], "<u4"), row["n_ids"]).astype("<u4")
    return np.split(flat, np.cumsum(row["n_tokens"])[:-1])


def documents(spark: SparkSession, path: str) -> DataFrame:
    """What the files hold of each document: doc_id, start, n_tokens, ids_crc32."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                n = np.array(row["n_tokens"], dtype=np.int64)
                start = row["base"] + np.cumsum(n) - n
                crc = [zlib.crc32(x.tobytes()) for x in decoded(row)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(start), pa.array(n), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    picked = read(spark, path).select("doc_ids", "n_tokens", "n_ids", "block_offsets", "words", "base")
    return picked.mapInArrow(go, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def op2_simple8b_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{checkpoint_dir(spark).rstrip('/')}/token-files-{uuid.uuid4().hex}"
    write(table(spark, sf_dir, "documents"), path)
    return documents(spark, path)
