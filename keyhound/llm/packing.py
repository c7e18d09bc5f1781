"""Sum-of-squares online packing of token ids into sequences.

A document of `length` tokens or more gives full sequences first. What is left goes, whole, to the fill level
that makes the sum over all levels of (open sequences at that level) squared smallest; ties go to the fullest
level. The counts stand in a level array, so a placement costs one vector operation over the levels. When the last
document has come, the sequences still open (some 400 of 2048 tokens, however many documents there were) are the
residue: their pieces are laid end to end and cut to full sequences, and what is left over at powers of two, which
need no padding. The column `placed` says how each piece got its place: full, online or residue.

Documents are encoded where they are read. Their remainders are dealt by a hash to packers of about `per_task`
documents each, in a fixed order, so few of them end in a residue, the input's tasks don't matter, and a task that is
run again gives the same pieces. A packer holds its open sequences only.

Defined cases: a null or empty text is its end id alone; repeated rows are packed once each; null doc_ids stay null;
a text of any length is cut into full sequences; other columns are ignored; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, vacated
from .tokens import encoding, slices, vocabulary_path

LENGTH = 2048
END_ID = 1
#: Documents of one packer.
PER_TASK = 1 << 15
SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, placed string"
#: Sequence ids are the packer's number times this, plus a number within it.
STRIDE = 1 << 33
#: What a document gives: full sequences without ids, as they are never cut again, and a remainder with them.
_CODED = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, ids binary"


class Packer:
    """Packs pieces (doc_id, start, length, crc, doc_tokens, ids) one after another; take() gives the rows placed for good so far."""

    def __init__(self, length: int = LENGTH, first_id: int = 0):
        self.length, self.next_id = length, first_id
        self.counts = np.zeros(length, dtype=np.int64)  # open sequences at each level; level 0 stands for a new one
        self.at: list[list[list]] = [[] for _ in range(length)]  # the pieces of each open sequence, by level
        self.rows: list[tuple] = []

    def _emit(self, pieces: list[tuple], placed: str) -> None:
        offset = 0
        for doc_id, start, n, crc, total, _ in pieces:
            self.rows.append((doc_id, start, n, crc, total, self.next_id, offset, placed))
            offset += n
        self.next_id += 1

    def level(self, size: int) -> int:
        """The level of at least 0 that an item of this size goes to."""
        n, length = self.counts, self.length
        below = n[: length - size + 1]
        after = np.zeros(length - size + 1, dtype=np.int64)
        after[: length - size] = n[size:]
        cost = 2 * (after - below) + 2
        cost[length - size] = 1 - 2 * below[length - size]  # the sequence is full and leaves the array
        cost[below == 0] = np.iinfo(np.int64).max
        cost[0] = 2 * after[0] + 1 if size < length else 0
        return int(length - size - np.argmin(cost[::-1]))

    def add(self, piece: tuple) -> None:
        size = piece[2]
        if size == self.length:
            self._emit([piece], "full")
            return
        level = self.level(size)
        pieces = []
        if level:
            pieces = self.at[level].pop()
            self.counts[level] -= 1
        pieces.append(piece)
        if level + size == self.length:
            self._emit(pieces, "online")
            return
        self.at[level + size].append(pieces)
        self.counts[level + size] += 1

    def close(self) -> None:
        """Cuts the open sequences' pieces to full sequences and a tail of powers of two."""
        left = sum(level * len(x) for level, x in enumerate(self.at))
        if not left:
            return
        tail = left % self.length
        sizes = [self.length] * (left // self.length) + [1 << b for b in range(self.length.bit_length(), -1, -1) if tail >> b & 1]
        room, open_ = sizes.pop(0), []
        for level in range(self.length - 1, -1, -1):
            for doc_id, start, _, _, total, raw in (piece for pieces in self.at[level] for piece in pieces):
                ids = np.frombuffer(raw, "<u4")
                while len(ids):
                    part = ids[:room]
                    open_.append((doc_id, start, len(part), zlib.crc32(part.tobytes()), total, None))
                    start, ids, room = start + len(part), ids[len(part) :], room - len(part)
                    if not room:
                        self._emit(open_, "residue")
                        open_, room = [], sizes.pop(0) if sizes else 0
            self.at[level] = []
        self.counts[:] = 0

    def take(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


def cut_ids(doc_id: int | None, ids: np.ndarray, length: int = LENGTH) -> Iterator[tuple]:
    """A document's full sequences, without ids, and its remainder, with them."""
    total = len(ids)
    for s in range(0, total, length):
        part = ids[s : s + length].astype("<u4").tobytes()
        n = len(part) // 4
        yield doc_id, s, n, zlib.crc32(part), total, part if n < length else None


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(cols, fields, strict=True)], [n for n, _ in fields])


def encoded(docs: DataFrame, path: str, length: int, end_id: int) -> DataFrame:
    """docs (doc_id, text) as _CODED: full sequences and remainders."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoding(path)
        for part in (x for b in batches for x in slices(b)):
            ids, bounds = encoder.encode(part.column("text"))
            rows = []
            for k, doc_id in enumerate(part.column("doc_id").to_pylist()):
                rows += cut_ids(doc_id, np.append(ids[bounds[k] : bounds[k + 1]], np.uint32(end_id)), length)
            yield _batch(rows, _CODED)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(go, _CODED)


def pack(docs: DataFrame, vocabulary: str | None = None, length: int = LENGTH, end_id: int = END_ID, per_task: int = PER_TASK) -> DataFrame:
    """One row for each piece: see SCHEMA. Sequences are padded by whoever writes them out."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vacated()  # encoding is over
        packer = Packer(length, TaskContext.get().partitionId() * STRIDE)
        for b in batches:
            for piece in zip(*(c.to_pylist() for c in b.columns), strict=True):
                packer.add(piece)
            yield _batch(packer.take(), SCHEMA)
        packer.close()
        yield _batch(packer.take(), SCHEMA)

    names = [x.split()[0] for x in _CODED.split(", ")]
    packers = max(1, -(-docs.count() // per_task))
    coded = encoded(docs, vocabulary or vocabulary_path(), length, end_id).withColumn("deal", F.xxhash64("doc_id", "start", "ids_crc32"))
    dealt = coded.repartition(packers, "deal").sortWithinPartitions("deal", "doc_id", "start", "ids_crc32", "doc_tokens")
    return dealt.select(*names).mapInArrow(go, SCHEMA)


def op3_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
