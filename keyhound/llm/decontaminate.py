"""Benchmark decontamination: one Aho-Corasick automaton over normalised benchmark texts.

A text's words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after A-Z are lower-cased. The automaton holds every
window of `window` consecutive words of an item (an item of fewer, but not none, is one window) as a string of one
symbol for each word, so a window of ten words is some twenty nodes at most. A document's words become symbols too (words of no
item a symbol of no window), its string is scanned once, and matches are ranges of its words at once; `marked` gives
them as ranges of words and of the original text's code points.

The plan is a map over documents: no shuffle, so no key can be hot. The benchmark's windows are collected and
broadcast as a built automaton; each holds up to `max_windows` windows (some 100 MB). A larger benchmark makes several,
by the windows' hash, broadcast apart: documents are still read and scanned in one pass, each batch by one automaton
after another, of which one is in a worker's memory at a time.

Defined cases: null and empty texts have no words and no hits; a null item id counts as the empty string; a null
or repeated doc_id keeps its row, and each row is judged by its own text; ties of windows merge; an empty benchmark
contaminates nothing; texts may be of any length; other columns are kept whatever their names.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_BYTES, cut, loaded, picked, table, utf8, vacated

WINDOW = 10
#: Windows in one automaton.
MAX_WINDOWS = 250_000
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_MARK = "n_words bigint, hit_from array<int>, hit_to array<int>, char_from array<int>, char_to array<int>, items array<string>"


def words(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


def _windows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys, items = [], []
        for item, text in zip(b.column("item_id").to_pylist(), utf8(b.column("text")), strict=True):
            w = words(text)
            for i in range(max(1, len(w) - window + 1) if w else 0):
                keys.append(b" ".join(w[i : i + window]))
                items.append("" if item is None else item)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(items, pa.string())], ["key", "item"])


def windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct windows (key binary, item string) of the benchmark's items."""
    rows = picked(benchmark, item_id="string", text="string")
    return rows.mapInArrow(lambda it: _windows(it, window), "key binary, item string").distinct()


class Automaton:
    """Windows of words, and the items that each belongs to."""

    #: A word's symbol is a number to this base, each of its places with characters of its own, so that no match begins
    #: within a symbol and no state has more than BASE ways on.
    BASE = 64

    def __init__(self, pairs: list[tuple[bytes, str]]):
        import ahocorasick

        items: dict[bytes, list[str]] = {}
        for key, item in pairs:
            items.setdefault(key, []).append(item)
        distinct = sorted({w for key in items for w in key.split(b" ")})
        self.width = next(k for k in itertools.count(1) if self.BASE**k >= len(distinct))
        self.none = "\0" * self.width
        self.symbols = {w: self._symbol(i) for i, w in enumerate(distinct)}
        self.search = ahocorasick.Automaton()
        for key, own in items.items():
            w = key.split(b" ")
            self.search.add_word("".join(map(self.symbols.__getitem__, w)), (len(w), tuple(own)))
        self.empty = not items
        if items:
            self.search.make_automaton()

    def _symbol(self, i: int) -> str:
        return "".join(chr(1 + self.BASE * k + i // self.BASE**k % self.BASE) for k in range(self.width))

    def scan(self, w: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """The ranges of words hit (end excluded), and the items that occur."""
        if self.empty or not w:
            return [], set()
        text = "".join(map(self.symbols.get, w, itertools.repeat(self.none)))
        hits, items = [], set()
        for end, (n, own) in self.search.iter(text):
            last = end // self.width + 1
            hits.append((last - n, last))
            items.update(own)
        return hits, items


def _merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    merged: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if merged and a <= merged[-1][1]:
            merged[-1] = merged[-1][0], max(b, merged[-1][1])
        else:
            merged.append((a, b))
    return merged


def spans(text: bytes, hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges of hit words as ranges of the original text's code points."""
    if not hits:
        return []
    at = [m.span() for m in _WORD.finditer(text)]
    points = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
    return [(int(points[at[a][0]]), int(points[at[b - 1][1]])) for a, b in hits]


def automata(benchmark: DataFrame, window: int = WINDOW, max_windows: int = MAX_WINDOWS) -> list:
    """Broadcasts of the benchmark's automata: one, or more beyond max_windows."""
    keys = cut(windows(benchmark, window))
    n = max(1, math.ceil(keys.count() / max_windows))
    sc, out = benchmark.sparkSession.sparkContext, []
    for i in range(n):
        part = keys if n == 1 else keys.where(F.pmod(F.xxhash64("key"), F.lit(n)) == i)
        out.append(sc.broadcast(Automaton([(bytes(r.key), r["item"]) for r in part.collect()])))
    return out


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """docs' rows, their columns renamed to c0, c1, ..., and a column `mark` (see _MARK) of each row's text."""
    shards = automata(benchmark, window, max_windows)
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    text = f"c{docs.columns.index('text')}"
    names, kinds = [*(x.split()[0] for x in _MARK.split(", "))], plain.dtypes

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vacated()
        for b in batches:
            texts = utf8(b.column(text))
            split = [words(t) for t in texts]
            hits, items = [[] for _ in texts], [set() for _ in texts]
            for a in loaded(shards):
                for i, w in enumerate(split):
                    own, found = a.scan(w)
                    hits[i] += own
                    items[i] |= found
            rows = []
            for t, w, own, found in zip(texts, split, hits, items, strict=True):
                own = _merge(own)
                points = spans(t, own)
                rows.append((len(w), [x for x, _ in own], [x for _, x in own], [x for x, _ in points], [x for _, x in points], sorted(found)))
            ints = pa.list_(pa.int32())
            cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 6, (pa.int64(), ints, ints, ints, ints, pa.list_(pa.string())), strict=True)]
            mark = pa.StructArray.from_arrays(cols, names)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c, _ in kinds), mark], [*(c for c, _ in kinds), "mark"])

    mark = ", ".join(x.replace(" ", ": ", 1) for x in _MARK.split(", "))
    typed = plain.withColumn(text, F.col(text).cast("string"))
    return typed.mapInArrow(go, ", ".join(f"{c} {k}" for c, k in typed.dtypes) + f", mark struct<{mark}>")


def marked(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, name: str = "decontam", max_windows: int = MAX_WINDOWS) -> DataFrame:
    """docs with a column `name` (struct n_words, hit_from, hit_to, char_from, char_to, items): what of each text is in the benchmark."""
    return scan(docs, benchmark, window, max_windows).toDF(*docs.columns, name)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """docs without the documents in which a benchmark window occurs; same columns."""
    kept = scan(docs, benchmark, window, max_windows).where(F.size("mark.hit_from") == 0).drop("mark")
    return kept.toDF(*docs.columns)


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = marked(picked(table(spark, sf_dir, "documents"), doc_id="bigint", text="string"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate(F.zip_with("decontam.hit_to", "decontam.hit_from", lambda b, a: (b - a).cast("bigint")), F.lit(0).cast("bigint"), lambda s, x: s + x)
    return m.select(
        "doc_id",
        F.col("decontam.n_words").alias("n_words"),
        hit.alias("n_hit"),
        F.size("decontam.items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("decontam.items", ",").cast("binary"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT coalesce(CAST(item_id AS VARCHAR), '') AS item, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS k
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM bw WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM windows), places AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS k
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw CROSS JOIN sizes WHERE len(w) >= n)
), found AS (SELECT doc_id, i, p.n, item FROM places p JOIN windows USING (n, k)),
hit AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""
