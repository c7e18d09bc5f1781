"""SimHash near-duplicates: fingerprints of word shingles, exact links by pivot tables, connected components.

A shingle is `shingle` consecutive words, A-Z lower-cased, joined by blanks; a text of fewer words, but not none, is
one shingle. A bit of the fingerprint is 1 if it is set in over half of the shingles' XXH64 hashes (seed 42).
Fingerprints of 256 bits add three mixed copies of each hash.

Equal fingerprints are one node, whatever their number of documents. Links of at most `max_bits` come from pivot
distance tables: the Hamming distances of fingerprints to reference fingerprints are tabled, pairs whose distances to
any reference differ by more than `max_bits` are discarded, and the survivors are verified. Random references discard
some 99.95 % of random pairs (see the README), which isn't enough alone: of all pairs of a billion fingerprints it would leave 10**14. So
the pairs to look at come from buckets: the fingerprint's bits are cut into `max_bits` + 2 blocks, and there is a
table for each two blocks. A pair of at most `max_bits` differing bits agrees in two blocks at least, so it meets in a
bucket of some table, and no link is lost, at any number of bits. A bucket gives a spanning forest of its links, never
its pairs.

Buckets of over `max_bucket` fingerprints aren't compared in one task: they are cut into blocks and every two blocks
meet in a task of their own, which loses no link.

The pipeline's near-duplicates are those of `drop_near_duplicates`: sets of shingles compared exactly.

Defined cases: null and empty texts have the fingerprint zero and are linked like any other; rows with a null doc_id
have a fingerprint, no component (null), and link nothing; rows that repeat a doc_id are nodes of one component only
where their texts link; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table, utf8, vacated
from .common import picked as picked_
from .components import components

SEED = 42
SHINGLE, MAX_BITS = 4, 4
PIVOTS = 16
MAX_BUCKET = 1 << 16
_MASK = (1 << 64) - 1
#: MinHash tables and the least hashes that make a key: a pair at 0.8 meets in none with probability (1 - 0.8^5)^28.
TABLES, ROWS = 28, 5
_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, TABLES * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Sets of a component that one task compares with as many others.
BLOCK = 1024


def hashes(text: bytes, shingle: int) -> np.ndarray:
    """XXH64 of every shingle of a text."""
    w = text.lower().split()  # bytes: A-Z and ASCII white space only
    if len(w) <= shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(w), SEED)] if w else [], dtype=np.uint64)
    joined, ends = b" ".join(w), list(itertools.accumulate(len(x) + 1 for x in w))
    starts = [0, *ends]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[shingle - 1 :], strict=False)), np.uint64, len(w) - shingle + 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def majority(h: np.ndarray) -> int:
    """The number whose bits are set in over half of the numbers."""
    b = h.view(np.uint8).reshape(-1, 8)
    if len(h) < 256:
        counts = np.unpackbits(b, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    else:
        counts = np.concatenate([np.bincount(b[:, i], minlength=256) @ _BITS for i in range(8)])
    return int(np.packbits(2 * counts > len(h), bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes, shingle: int = SHINGLE, words: int = 1) -> list[int]:
    """`words` 64-bit words; the first is the plain SimHash."""
    h = hashes(text, shingle)
    with np.errstate(over="ignore"):
        return [majority(mix(h + np.uint64(i * 0x9E3779B97F4A7C15 & _MASK)) if i else h) if len(h) else 0 for i in range(words)]


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, words: int = 1) -> DataFrame:
    """doc_id and f0, f1, ... (signed 64-bit) for each row of docs."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vacated()
        for b in batches:
            found = np.array([fingerprint(t, shingle, words) for t in utf8(b.column("text"))], dtype=np.uint64).reshape(-1, words).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(found[:, i]) for i in range(words))], ["doc_id", *(f"f{i}" for i in range(words))])

    picked = picked_(docs, doc_id="bigint", text="string")
    return picked.mapInArrow(go, "doc_id bigint, " + ", ".join(f"f{i} bigint" for i in range(words)))


def _selections(words: int, max_bits: int) -> list[np.ndarray]:
    """The bits of each table: two of max_bits + 2 blocks. Beyond 64 bits a key is a hash of them."""
    return [np.concatenate(two) for two in itertools.combinations(np.array_split(np.arange(64 * words), max_bits + 2), 2)]


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def forest(f: np.ndarray, max_bits: int, pivots: np.ndarray, tally: list[int] | None = None) -> list[tuple[int, int]]:
    """Links of at most max_bits that join what can be joined; f: a row of words for each fingerprint.

    tally: gets the numbers of pairs looked at, left by the pivots, and linked, added up.
    """
    coords = np.stack([_distance(f, p) for p in pivots], axis=1).astype(np.int16)
    rest, found = np.arange(len(f)), []
    while len(rest) > 1:
        stack, rest = [rest[0]], rest[1:]
        while stack and len(rest):
            x = stack.pop()
            near = np.flatnonzero(np.abs(coords[rest, 0] - coords[x, 0]) <= max_bits) if len(rest) > 64 else np.arange(len(rest))
            near = near[(np.abs(coords[rest[near]] - coords[x]) <= max_bits).all(axis=1)]
            hit = near[_distance(f[rest[near]], f[x]) <= max_bits]
            if tally is not None:
                tally[:] = [tally[0] + len(rest), tally[1] + len(near), tally[2] + len(hit)]
            if len(hit):
                own = rest[hit]
                found += [(int(x), int(y)) for y in own]
                stack += own.tolist()
                rest = np.delete(rest, hit)
    return found


def _bucketed(words: int, max_bits: int, max_bucket: int | None, keys: list[str]):
    """A function over rows sorted by `keys`: links within each bucket, and the rows of buckets that are too large."""
    pivots = mix(np.arange(1, PIVOTS * words + 1, dtype=np.uint64)).reshape(PIVOTS, words)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(k: np.ndarray, f: np.ndarray, rep: np.ndarray) -> None:
            """Takes whole buckets in order of their keys."""
            new = np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1
            starts, ends = np.concatenate([[0], new]), np.concatenate([new, [len(k)]])
            for a, b in zip(starts[ends - starts > 1], ends[ends - starts > 1], strict=True):
                links = forest(f[a:b], max_bits, pivots)
                us.extend(rep[a + x] for x, _ in links)
                vs.extend(rep[a + y] for _, y in links)

        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        n_held, last, big, seq = 0, None, False, 0
        for batch in itertools.chain(batches, [None]):
            us, vs, out = [], [], []
            if batch is not None and batch.num_rows:
                k = np.stack([batch.column(c).to_numpy() for c in keys], axis=1)
                f = np.stack([batch.column(f"f{i}").to_numpy() for i in range(words)], axis=1).view(np.uint64)
                rep = batch.column("rep").to_numpy()
                while len(k):
                    if last is not None and (k[0] == last).all():
                        same = len(k) if (k[-1] == last).all() else int(np.argmax((k != last).any(axis=1)))
                        part, k, f, rep = (k[:same], f[:same], rep[:same]), k[same:], f[same:], rep[same:]
                        if big:
                            out.append((part, seq))
                            seq += same
                        else:
                            held.append(part)
                            n_held += same
                            if max_bucket and n_held > max_bucket:
                                big = True
                                for p in held:
                                    out.append((p, seq))
                                    seq += len(p[0])
                                held, n_held = [], 0
                        continue
                    if held:
                        close(*(np.concatenate(x) for x in zip(*held, strict=True)))
                    held, n_held, big, seq = [], 0, False, 0
                    last = k[-1]
                    tail = len(k) - int(np.argmax((k[::-1] != last).any(axis=1))) if (k[0] != last).any() else 0
                    if tail:
                        close(k[:tail], f[:tail], rep[:tail])
                    k, f, rep = k[tail:], f[tail:], rep[tail:]
            elif batch is None and held:
                close(*(np.concatenate(x) for x in zip(*held, strict=True)))
            cols = {"u": us, "v": vs, "t": [], "k": [], "n": []} | {f"f{i}": [] for i in range(words)}
            for name in ("t", "k", "n", *(f"f{i}" for i in range(words))):
                cols[name] = [None] * len(us)
            for (kk, ff, rr), at in out:
                cols["u"].extend(rr.tolist())
                cols["v"].extend([None] * len(rr))
                cols["t"].extend(kk[:, 0].tolist())
                cols["k"].extend(kk[:, 1].tolist())
                cols["n"].extend(range(at, at + len(rr)))
                for i in range(words):
                    cols[f"f{i}"].extend(ff[:, i].view(np.int64).tolist())
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols.values()], list(cols))

    return go


def links(nodes: DataFrame, words: int, max_bits: int, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """Edges (u, v) between the rep of fingerprints (rep, f0, ...) that are at most max_bits apart; see the module."""
    chosen = _selections(words, max_bits)
    names = [f"f{i}" for i in range(words)]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in (b.slice(i, 4096) for i in range(0, b.num_rows, 4096)):
                f = np.stack([part.column(c).to_numpy() for c in names], axis=1)
                bits = np.unpackbits(np.ascontiguousarray(f).view(np.uint8), axis=1, bitorder="little")
                for t, own in enumerate(chosen):
                    key = np.packbits(bits[:, own], axis=1, bitorder="little")
                    wide = np.zeros((len(f), -(-key.shape[1] // 8) * 8), dtype=np.uint8)
                    wide[:, : key.shape[1]] = key
                    k = wide.view(np.uint64)
                    with np.errstate(over="ignore"):
                        one = k[:, 0] if k.shape[1] == 1 else np.bitwise_xor.reduce(mix(k + np.arange(k.shape[1], dtype=np.uint64)), axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(f), t)), pa.array(one.view(np.int64)), part.column("rep"), *(part.column(c) for c in names)], ["t", "k", "rep", *names])

    return _met(nodes.select("rep", *names).mapInArrow(deal, _typed(["t", "k", "rep", *names])), words, max_bits, max_bucket)


def _typed(cols: list[str]) -> str:
    return ", ".join(f"{c} bigint" for c in cols)


def _met(rows: DataFrame, words: int, max_bits: int, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """Edges (u, v) that join what is at most max_bits apart within a bucket; rows: t, k (the bucket), rep, f0, ..."""
    names = [f"f{i}" for i in range(words)]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = rows.repartition(n, "t", "k").sortWithinPartitions("t", "k")
    out = cut(sorted_.mapInArrow(_bucketed(words, max_bits, max_bucket, ["t", "k"]), _typed(["u", "v", "t", "k", "n", *names])))
    edges = out.where(F.col("t").isNull()).select("u", "v")
    large = out.where(F.col("t").isNotNull())
    if large.isEmpty():
        return edges
    # Every two blocks of a large bucket meet: b1 <= b2, and a block of its own meets itself.
    half = max(1, max_bucket // 2)
    large = large.withColumn("b", F.floor(F.col("n") / half))
    blocks = large.groupBy("t", "k").agg(F.max("b").alias("last"))
    met = large.join(blocks, ["t", "k"]).withColumn("o", F.explode(F.sequence(F.lit(0), "last")))
    met = met.select("t", "k", F.least("b", "o").alias("b1"), F.greatest("b", "o").alias("b2"), F.col("u").alias("rep"), *names)
    met = met.repartition(n, "t", "k", "b1", "b2").sortWithinPartitions("t", "k", "b1", "b2")
    more = met.mapInArrow(_bucketed(words, max_bits, None, ["t", "k", "b1", "b2"]), _typed(["u", "v", "t", "k", "n", *names]))
    return edges.unionByName(more.select("u", "v"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, words: int = 1, max_bits: int = MAX_BITS, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """doc_id, f0, ..., component_id for each row of docs."""
    names = [f"f{i}" for i in range(words)]
    found = cut(fingerprints(docs, shingle, words))
    nodes = cut(found.where(F.col("doc_id").isNotNull()).groupBy(*names).agg(F.min("doc_id").alias("rep")))
    joined = components(links(nodes, words, max_bits, max_bucket))
    label = nodes.join(joined, F.col("rep") == F.col("node"), "left").select(*(F.col(c).alias(f"n_{c}") for c in names), F.coalesce("component", "rep").alias("label"))
    same = [F.col(c) == F.col(f"n_{c}") for c in names]
    out = found.join(label, same, "left")
    return out.select("doc_id", *names, F.when(F.col("doc_id").isNotNull(), F.col("label")).alias("component_id"))


def _grams(text: bytes, shingle: int) -> np.ndarray:
    """The set of a text's shingles: their distinct hashes, in order."""
    return np.unique(hashes(text, shingle))


def bands(grams: np.ndarray) -> np.ndarray:
    """A key for each of the MinHash tables; texts of the same least hashes in all rows of a table share its key."""
    if not len(grams):
        return np.zeros(TABLES, dtype=np.uint64)
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(grams), 4096):
        np.minimum(least, (_FACTORS[:, None] * grams[None, i : i + 4096]).min(axis=1), out=least)
    keys = np.zeros(TABLES, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for row in least.reshape(ROWS, TABLES):
            keys = mix(keys + row + np.uint64(0x9E3779B97F4A7C15))
    return keys


def sketches(docs: DataFrame, shingle: int, words: int, sets: bool = False) -> DataFrame:
    """docs (doc_id, text, ...) with s (a hash of the set of shingles) and f0, ... (SimHash of the set) for the text, and its keys or, on demand, the set itself as grams."""
    names, last = [f"f{i}" for i in range(words)], "grams" if sets else "keys"
    kept = [c for c in docs.columns if c != "text"]

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vacated()
        for part in (b.slice(i, 1024) for b in batches for i in range(0, b.num_rows, 1024)):
            found = [_grams(t, shingle) for t in utf8(part.column("text"))]
            with np.errstate(over="ignore"):
                f = [[majority(mix(g + np.uint64(i * 0x9E3779B97F4A7C15 & _MASK)) if i else g) if len(g) else 0 for i in range(words)] for g in found]
            f = np.array(f, dtype=np.uint64).reshape(-1, words).view(np.int64)
            raw = [g.tobytes() for g in found]
            s = np.array([xxhash.xxh64_intdigest(x, SEED) for x in raw], dtype=np.uint64).view(np.int64)
            end = pa.array(raw if sets else [bands(g).tobytes() for g in found], pa.binary())
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(s), *(pa.array(f[:, i]) for i in range(words)), end], [*kept, "s", *names, last])

    return docs.mapInArrow(go, _typed([*kept, "s", *names]) + f", {last} binary")


def similar(a: np.ndarray, b: np.ndarray, ratio: Fraction) -> bool:
    """Whether the Jaccard similarity of two sets is at least the ratio; two empty sets are alike."""
    small, large = sorted((len(a), len(b)))
    if small * ratio.denominator < large * ratio.numerator:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * ratio.denominator >= (len(a) + len(b) - both) * ratio.numerator


def _verified(members: DataFrame, words: int, ratio: Fraction, max_bits: int, block: int = BLOCK) -> DataFrame:
    """Edges (u, v) that join all similar sets of each component; members: component, s, f0, ..., grams.

    All members first meet the component's least; those that aren't similar to it then meet all others, in blocks,
    so a large group of copies of one text costs one comparison for each.
    """
    names = [f"f{i}" for i in range(words)]
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def star(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = zip(b.column("grams").to_pylist(), b.column("center").to_pylist(), strict=True)
            near = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), ratio) for x, y in pairs]
            yield pa.RecordBatch.from_arrays([b.column("component"), b.column("s"), pa.array(near, pa.bool_())], ["component", "s", "near"])

    center = members.where(F.col("s") == F.col("component")).select("component", F.col("grams").alias("center"))
    first = cut(members.select("component", "s", "grams").join(center, "component").mapInArrow(star, "component bigint, s bigint, near boolean"))
    edges = first.where("near").select(F.col("component").alias("u"), F.col("s").alias("v"))
    # Numbers of the members within their component, those that are left first: only their blocks meet all blocks.
    left = first.groupBy("component").agg(F.count(F.when(~F.col("near"), 1)).alias("far"), F.count("*").alias("size")).where("far > 0")
    blocks = left.select("component", F.ceil(F.col("far") / block).alias("far_blocks"), F.ceil(F.col("size") / block).alias("all_blocks"))
    placed = members.select("component", "s", *names, "grams").join(first.select("s", "near"), "s").join(blocks, "component")
    # A member's block is drawn from its hash, so that no task needs all members of a component.
    drawn = placed.withColumn("b", F.when(F.col("near"), F.pmod(F.col("s"), "all_blocks") + F.col("far_blocks")).otherwise(F.pmod(F.col("s"), "far_blocks")))
    every = F.col("far_blocks") + F.col("all_blocks") - 1
    met = drawn.withColumn("o", F.explode(F.when(F.col("near"), F.sequence(F.lit(0).cast("bigint"), F.col("far_blocks") - 1)).otherwise(F.sequence(F.lit(0).cast("bigint"), every))))
    met = met.select("component", F.least("b", "o").alias("b1"), F.greatest("b", "o").alias("b2"), "s", "near", *names, "grams")

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close() -> pa.RecordBatch:
            us, vs = [], []
            ids, near, f, sets = (list(x) for x in zip(*held, strict=True))
            fs, far, sizes = np.array(f, dtype=np.int64).view(np.uint64), ~np.array(near), np.array([len(g) for g in sets])
            rest = np.arange(len(ids))
            # Breadth first; near members are one group by their star, so they are never compared with each other.
            while len(rest):
                stack, rest = [rest[0]], rest[1:]
                while stack and len(rest):
                    x = stack.pop()
                    at = np.flatnonzero((_distance(fs[rest], fs[x]) <= max_bits) & (far[x] | far[rest]))
                    lo, hi = np.minimum(sizes[rest[at]], sizes[x]), np.maximum(sizes[rest[at]], sizes[x])
                    at = at[lo * ratio.denominator >= hi * ratio.numerator]
                    at = np.array([i for i in at if similar(sets[x], sets[rest[i]], ratio)], dtype=np.int64)
                    us.extend([ids[x]] * len(at))
                    vs.extend(ids[i] for i in rest[at])
                    stack += rest[at].tolist()
                    rest = np.delete(rest, at)
            return pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

        held, last = [], None
        for b in batches:
            c = {x: b.column(x).to_pylist() for x in ("component", "b1", "b2", "s", "near", "grams", *names)}
            for i in range(b.num_rows):
                key = (c["component"][i], c["b1"][i], c["b2"][i])
                if key != last and held:
                    yield close()
                    held = []
                last = key
                held.append((c["s"][i], c["near"][i], [c[x][i] for x in names], np.frombuffer(c["grams"][i], np.uint64)))
        if held:
            yield close()

    dealt = met.repartition(n, "component", "b1", "b2").sortWithinPartitions("component", "b1", "b2")
    return edges.unionByName(dealt.mapInArrow(go, "u bigint, v bigint"))


def candidate_bits(words: int) -> int:
    """The most bits by which the SimHashes of sets of Jaccard similarity 0.8 or more differ, but for one pair in 100,000.

    The chance of a bit is greatest, 3/16, for five shingles against four of them; long texts have 0.152.
    """
    n, p = 64 * words, 3 / 16
    return round(n * p + 4.5 * math.sqrt(n * p * (1 - p)))


def similar_sets(docs: DataFrame, shingle: int, similarity: float, words: int) -> DataFrame:
    """doc_id, own (a hash of the text) and group for each row of docs: the connected sets of shingles of at least this Jaccard similarity."""
    if similarity < 0.8:
        raise ValueError("tables and radius are made for similarities of 0.8 and more")
    ratio, names = Fraction(str(similarity)), [f"f{i}" for i in range(words)]
    picked = picked_(docs, doc_id="bigint", text="string").withColumn("own", F.xxhash64("text"))
    found = cut(sketches(picked, shingle, words))
    nodes = found.where(F.col("doc_id").isNotNull()).dropDuplicates(["s"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in (b.slice(i, 4096) for i in range(0, b.num_rows, 4096)):
                keys = np.frombuffer(b"".join(part.column("keys").to_pylist()), np.int64).reshape(-1, TABLES)
                for t in range(TABLES):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), t)), pa.array(keys[:, t]), *(part.column(c) for c in ("s", *names))], ["t", "k", "rep", *names])

    rows = nodes.select("s", *names, "keys").mapInArrow(deal, _typed(["t", "k", "rep", *names]))
    near = components(_met(rows, words, candidate_bits(words)))
    # Only candidates' texts are read again for their sets, one row for each set.
    chosen = cut(nodes.select("doc_id", "own", "s").join(near, F.col("s") == F.col("node")).select("doc_id", "own", "component"))
    texts = picked.join(chosen, ["doc_id", "own"]).dropDuplicates(["doc_id", "own"])
    members = cut(sketches(texts, shingle, words, sets=True).select("component", "s", *names, "grams"))
    joined = components(_verified(members, words, ratio, candidate_bits(words))).withColumnRenamed("component", "group")
    return found.select("doc_id", "own", "s").join(joined, F.col("s") == F.col("node"), "left").select("doc_id", "own", F.coalesce("group", "s").alias("group"))


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, words: int = 4) -> DataFrame:
    """docs with one document, that of the least doc_id, of each group of near-duplicates; same columns.

    Two documents are near-duplicates where the Jaccard similarity of their sets of shingles is at least `similarity`,
    and groups are connected by such pairs. Candidates share a MinHash table's key (a pair at 0.8 shares none of the
    28 with a probability of 0.00002) and have SimHashes of 64 * words bits within `candidate_bits`; what is linked is
    decided by the sets themselves. Where a doc_id is repeated, each of its rows goes or stays by its own text; rows of
    the group's least doc_id all stay, and so do rows without a doc_id.
    """
    found = similar_sets(docs, shingle, similarity, words).where(F.col("doc_id").isNotNull())
    least = found.groupBy("group").agg(F.min("doc_id").alias("least"))
    losing = found.distinct().join(least, "group").where(F.col("least") < F.col("doc_id")).select(F.col("doc_id").alias("lost_id"), F.col("own").alias("lost_text")).distinct()
    names = [f"c{i}" for i in range(len(docs.columns))]
    ident, text = (names[docs.columns.index(c)] for c in ("doc_id", "text"))
    same = (F.col(ident) == F.col("lost_id")) & (F.xxhash64(F.col(text).cast("string")) == F.col("lost_text"))
    return docs.toDF(*names).join(losing.hint("shuffle_hash"), same, "left_anti").toDF(*docs.columns)


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")
