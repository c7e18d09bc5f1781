"""Document fingerprints by I-Match: terms of an inverse-document-frequency band, hashed in randomised sub-lexicons.

A text's terms are its distinct words (see `decontaminate`), by 64-bit hash. The lexicon holds the terms whose share of
documents lies in a band: at least `MIN_SHARE` (and two documents) and at most `MAX_SHARE`, an idf of 3.0 to 9.2.
Documents are counted exactly for each term: a task sums its own counts before they are shuffled. A term of the lexicon
stands in MIN_SHARE of all documents, so the lexicon holds no more than a document's mean number of terms / MIN_SHARE,
whatever the corpus's size: some millions of 8 bytes, which is what is collected and broadcast.

Sub-lexicons are fixed: the whole lexicon, and for each density of 4**-1 to 4**-LEVELS, `SUBSETS` parts of it that keep
each term with that probability, drawn by salted hashes of the terms. For each sub-lexicon, the text's terms in it are
sorted and the list is hashed: to 64 bits for the whole lexicon, which is plain I-Match, and to 16 bits for the others.
As texts have from one to tens of thousands of terms, some density always leaves a text a term or two in each part, and
those lists survive an edit. Two fingerprints' likeness is the largest share, over the densities, of parts with equal
lists among the parts in which either text has a term (of half of the parts at least); equal fingerprints have 1.

Documents follow each other by (doc_id, text's hash, text). Ranges of that order are dealt to tasks by bounds taken from
a sample, which fixes only what meets where; each range also gets the first document of the next one that has any.

Defined cases: null texts are empty; a text without a term in the lexicon has the hash of all its terms, and is like
equal fingerprints only; null doc_ids come first; repeated doc_ids are ordered by their texts; a single document is its
own next one; other columns are ignored; an empty table gives no rows; texts may be of any length.
"""

from __future__ import annotations

import gc
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import picked, released, table, vacated
from .decontaminate import words
from .simhash import mix

MIN_SHARE, MAX_SHARE = 1e-4, 0.05
SUBSETS, LEVELS = 16, 7
_SALTS = mix(np.arange(1, SUBSETS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15 & (1 << 63) - 1))
#: Counts that a task holds before it hands them over.
_HELD = 1 << 21
#: Rows of the sample for each range.
_SAMPLED = 40


class Terms(dict):
    """Word to hash, for the words seen last."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, 0)
        return h

    def of(self, text: bytes) -> np.ndarray:
        """The hashes of the distinct words, sorted."""
        own = set(words(text))
        return np.unique(np.fromiter(map(self.__getitem__, own), np.uint64, len(own)))


def frequencies(docs: DataFrame) -> DataFrame:
    """term, n: the number of documents of each term."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def merged() -> tuple[np.ndarray, np.ndarray]:
            terms, at = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            return terms, np.bincount(at, np.concatenate([c for _, c in held]), len(terms)).astype(np.int32)

        def packed(terms, counts) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(counts, pa.int32())], ["term", "n"])

        vacated()
        known, held, size = Terms(), [], 0
        for b in batches:
            for text in b.column("text").to_pylist():
                own = known.of(text.encode("utf-8", "surrogatepass")) if text else ()
                if len(own):
                    held.append((own, np.ones(len(own), np.int32)))
                    size += len(own)
                if size > _HELD:
                    held = [merged()]
                    size = len(held[0][0])
                    if size > _HELD // 2:
                        yield packed(*held[0])
                        held, size = [], 0
        if held:
            yield packed(*merged())
        known.clear()
        released()

    counted = picked(docs, text="string").mapInArrow(count, "term bigint, n int")
    return counted.groupBy("term").agg(F.sum("n").alias("n"))


def lexicon(docs: DataFrame, min_share: float = MIN_SHARE, max_share: float = MAX_SHARE) -> np.ndarray:
    """The terms within the band, sorted."""
    n = docs.count()
    low, high = max(2, math.ceil(min_share * n)), max(2, math.floor(max_share * n))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [b.column("term").to_numpy().tobytes() for b in batches]
        yield pa.RecordBatch.from_arrays([pa.array([b"".join(own)], pa.binary())], ["terms"])

    chosen = frequencies(docs).where(F.col("n").between(low, high)).select("term")
    rows = chosen.mapInArrow(pack, "terms binary").collect()  # bounded: see the module
    out = np.sort(np.frombuffer(b"".join(r.terms for r in rows), np.uint64))
    # The counts aren't needed any more: the driver's cleaner removes their shuffle files once their plan is collected.
    del chosen, rows
    gc.collect()
    docs.sparkSession.sparkContext._jvm.System.gc()
    return out


def fingerprint(terms: np.ndarray, lexicon: np.ndarray) -> bytes:
    """A byte that tells whether there are terms of the lexicon, a hash of all of them, and the parts' hashes by density."""
    at = np.searchsorted(lexicon, terms)
    h = terms[lexicon[np.minimum(at, len(lexicon) - 1)] == terms] if len(lexicon) else terms[:0]
    if not len(h):
        return b"\0" + hashlib.sha256(terms.tobytes()).digest()[:8]
    out = np.zeros(SUBSETS * LEVELS, dtype=np.uint64)
    with np.errstate(over="ignore"):
        drawn = mix(h[None, :] ^ _SALTS[:, None])  # a row for each salt; terms in order
        # A part of density 4**-level keeps a term if 2 * level leading bits are 0; denser parts hold sparser ones.
        part, term = np.nonzero(drawn < np.uint64(1 << 62))
        low = drawn[part, term]
        deep = np.ones(len(low), dtype=np.int64)
        for level in range(2, LEVELS + 1):
            deep += low < np.uint64(1 << 64 - 2 * level)
        first = np.cumsum(deep) - deep
        level = np.arange(int(deep.sum())) - np.repeat(first, deep)
        group = level * SUBSETS + np.repeat(part, deep)
        order = np.argsort(group, kind="stable")  # terms stay in order
        group, own = group[order], h[np.repeat(term, deep)[order]]
        if len(group):
            begin = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            rank = np.arange(len(group)) - np.repeat(begin, np.diff([*begin, len(group)]))
            listed = mix(own + mix(rank.astype(np.uint64) + np.uint64(1)))  # the list: each term with its place
            out[group[begin]] = np.uint64(1) + mix(np.add.reduceat(listed, begin)) % np.uint64(65535)
    return b"\1" + xxhash.xxh64_digest(h.tobytes()) + out.astype("<u2").tobytes()


def likeness(a: bytes, b: bytes) -> float:
    if a == b:
        return 1.0
    if not a[0] or not b[0]:
        return 0.0
    x, y = (np.frombuffer(f, "<u2", offset=9).reshape(LEVELS, SUBSETS) for f in (a, b))
    seen = (x > 0) | (y > 0)
    return float((((x == y) & seen).sum(axis=1) / np.maximum(seen.sum(axis=1), SUBSETS // 2)).max())


def edited(text: str, following: str) -> str:
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def _ranged(docs: DataFrame, ranges: int) -> DataFrame:
    """docs (doc_id, text, h) with the number of their range in the order of (doc_id, h)."""
    keys = docs.select(F.col("doc_id").isNotNull().alias("there"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "h")
    n = docs.count()
    rows = keys.sample(min(1.0, _SAMPLED * ranges / max(n, 1)), 42).collect() if ranges > 1 else []
    rows = sorted(tuple(r) for r in rows)
    bounds = [rows[i * len(rows) // ranges] for i in range(1, ranges)] if len(rows) >= ranges else []
    if not bounds:
        return docs.withColumn("part", F.lit(0))
    cols = [np.array(c) for c in zip(*bounds, strict=True)]

    @F.pandas_udf("int")
    def part(there, doc_id, h):
        import pandas as pd

        m = len(cols[0])
        # Bounds come before rows that are equal to them; a row's range is the number of bounds up to it.
        both = [np.concatenate([c, x.to_numpy()]) for c, x in zip(cols, (there, doc_id, h), strict=True)]
        order = np.lexsort((np.arange(m + len(h)) >= m, both[2], both[1], both[0]))
        out = np.zeros(m + len(h), dtype=np.int32)
        out[order] = np.cumsum(order < m)
        return pd.Series(out[m:])

    return docs.withColumn("part", part(F.col("doc_id").isNotNull(), F.coalesce("doc_id", F.lit(0)), "h"))


def fingerprints(docs: DataFrame, min_share: float = MIN_SHARE, max_share: float = MAX_SHARE) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row of docs."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(lexicon(docs, min_share, max_share))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows_ = picked(docs, doc_id="bigint", text="string").withColumn("text", F.coalesce("text", F.lit("")))
    ranged = _ranged(rows_.withColumn("h", F.xxhash64("text")), n)

    def rows(triples: Iterator[tuple[int | None, str, int]]) -> Iterator[tuple]:
        """Documents in order, each range followed by the document after it, of which only the text is used (tail 1)."""
        vacated()
        known, before = Terms(), None
        for doc_id, text, tail in triples:
            own = fingerprint(known.of(text.encode("utf-8", "surrogatepass")), shared.value)
            if before is not None:
                last_id, last, print_ = before
                changed = edited(last, text).encode("utf-8", "surrogatepass")
                other = fingerprint(known.of(changed), shared.value)
                yield last_id, len(last), hashlib.sha256(changed).hexdigest(), print_.hex(), other.hex(), likeness(print_, other), likeness(print_, own)
            before = None if tail else (doc_id, text, own)
        known.clear()
        released()

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for row in rows(x for b in batches for x in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "tail")), strict=True)):
            held.append(row)
            if len(held) == 1000:
                yield _result(held)
                held = []
        if held:
            yield _result(held)

    # Ranges are dealt by their number itself: by its hash some tasks would get several. The first document of each: its key first, without texts, then its text.
    order = F.struct(F.col("doc_id").isNotNull().alias("there"), "doc_id", "h")
    firsts = ranged.select("part", order.alias("k")).groupBy("part").agg(F.min("k").alias("k"))
    keys = sorted((r.part, r.k.doc_id, r.k.h) for r in firsts.collect())  # a row for each range
    schema = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    if not keys:
        return spark.createDataFrame([], schema)
    nexts = [(part, *keys[(i + 1) % len(keys)]) for i, (part, _, _) in enumerate(keys)]
    after = spark.createDataFrame(nexts, "to int, part int, k_id bigint, k_h bigint")
    found = ranged.join(F.broadcast(after.select(F.col("part").alias("k_part"), "to", "k_id", "k_h")), (F.col("part") == F.col("k_part")) & F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("h") == F.col("k_h")))
    tails = found.groupBy("to").agg(F.min_by(F.struct("doc_id", "text"), "text").alias("d")).select(F.col("d.doc_id").alias("doc_id"), F.col("d.text").alias("text"), F.col("to").alias("part"), F.lit(1).alias("tail"))
    all_ = ranged.select("doc_id", "text", "part", F.lit(0).alias("tail")).unionByName(tails)
    dealt = all_.repartitionById(n, "part").sortWithinPartitions("part", "tail", "doc_id", F.xxhash64("text"), "text")
    return dealt.select("doc_id", "text", "tail").mapInArrow(go, schema)


def _result(held: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)


def op9_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
