"""URL filters by Bloom filter cascades over the corpus's own keys.

A rule is (host, path, verdict). It fits a url whose host is the rule's host or a subdomain of it and whose path
starts with the rule's path; of several, the longest wins, and of two as long the one of the longer host. A url's keys are all pairs of a host suffix (at dots)
with a path prefix of a length that some rule has. For each verdict one cascade is built: level 0 is a Bloom filter
of the rules' keys, level 1 of those other keys of the corpus that level 0 lets through, level 2 of the rules' keys
that level 1 lets through, and so on until nothing is let through. Membership of any key of the corpus is exact, and
the urls join nothing.

Rules are dealt to shards by their keys' hash, `shard_rules` to a shard at most on average, and every shard has cascades
of its own, broadcast apart: a batch of urls is looked up in one shard after another, of which one is in a worker's
memory at a time. Level 0's rate of false positives is set from the number of the corpus's keys, which is counted, so
level 1 holds fewer keys than there are rules (0.71 times as many are expected at most), whatever the corpus's size: a
rule takes some 50 bits, and what is collected grows with the rules only. The corpus's keys are filtered by level 0
before they meet in a shuffle, so keys that many urls share don't gather in a task.

Defined cases: a null url or one without `://` has an empty host and path and no rule; an empty path starts with no
rule's path but an empty one; a rule given twice is one rule, and with both verdicts it blocks; there is a row for
each row of pages, also where page_ids or whole rows repeat or are null; urls may be of any length; other columns are
ignored; no rules leave the default; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import loaded, picked, table

#: (host, path, verdict): fixed values of the query's contract.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
DEFAULT_VERDICT = "allow"
SHARD_RULES = 1_000_000
_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: str | None) -> tuple[str, str]:
    rest = (url or "").partition("://")
    if not rest[1]:
        return "", ""
    rest = rest[2]
    end = min((i for i in map(rest.find, "?#") if i >= 0), default=len(rest))
    rest = rest[:end]
    slash = rest.find("/")
    return (rest if slash < 0 else rest[:slash]).translate(_UPPER), "" if slash < 0 else rest[slash:]


def keys(host: str, path: str, lengths: list[int]) -> list[str]:
    """The url's keys, longest first; lengths: of the rules' paths, descending."""
    if not host:
        return []
    hosts = [host, *(host[i + 1 :] for i, c in enumerate(host) if c == ".")]
    found = [h + path[:n] for h in hosts for n in lengths if n <= len(path)]
    return sorted(found, key=len, reverse=True)


def shard(key: str, shards: int) -> int:
    return xxhash.xxh3_64_intdigest(key.encode("utf-8", "surrogatepass"), seed=1 << 32) % shards if shards > 1 else 0


class Bloom:
    """k bits of `size` for each key; salt: the level, so that levels are independent."""

    def __init__(self, n: int, rate: float, salt: int):
        self.size = max(64, math.ceil(-n * math.log(rate) / math.log(2) ** 2))
        self.k = max(1, round(self.size / max(n, 1) * math.log(2)))
        self.k = min(self.k, 40)
        self.salt = salt
        self.bits = np.zeros(self.size // 8 + 1, dtype=np.uint8)

    def _places(self, key: str) -> Iterator[int]:
        h = xxhash.xxh3_128_intdigest(key.encode("utf-8", "surrogatepass"), seed=self.salt)
        a, b = h & (1 << 64) - 1, h >> 64 | 1
        return ((a + i * b) % self.size for i in range(self.k))

    def add(self, key: str) -> None:
        for p in self._places(key):
            self.bits[p >> 3] |= 1 << (p & 7)

    def __contains__(self, key: str) -> bool:
        return all(self.bits[p >> 3] >> (p & 7) & 1 for p in self._places(key))


class Cascade:
    """Exact membership for listed keys and for all other keys that it was built with."""

    def __init__(self, levels: list[Bloom]):
        self.levels = levels

    def __contains__(self, key: str) -> bool:
        for i, level in enumerate(self.levels):
            if key not in level:
                return i % 2 == 1
        return len(self.levels) % 2 == 1

    @classmethod
    def deepen(cls, first: Bloom, listed: set[str], passed: set[str]) -> Cascade:
        """passed: the keys that aren't listed and that the first level lets through."""
        levels, keep, out = [first], listed, passed
        while out:
            level = Bloom(len(out), 0.5, len(levels))
            for k in out:
                level.add(k)
            levels.append(level)
            keep, out = out, {k for k in keep if k in level}
        return cls(levels)


class _Looked:
    """The keys of a batch of urls, by shard."""

    def __init__(self, urls: list[str | None], lengths: list[int], shards: int):
        self.split = [split_url(u) for u in urls]
        self.keys = [keys(*x, lengths) for x in self.split]
        self.by_shard: list[dict[str, None]] = [{} for _ in range(shards)]
        for k in {k for own in self.keys for k in own}:
            self.by_shard[shard(k, shards)][k] = None


def build(urls: DataFrame, rules, shard_rules: int = SHARD_RULES) -> list:
    """Broadcasts of the cascades, a dictionary of verdict to cascade for each shard, over the keys of urls (column url)."""
    sc = urls.sparkSession.sparkContext
    rules = list(rules)
    n = max(1, math.ceil(len(rules) / shard_rules))
    listed = [{"allow": set(), "block": set()} for _ in range(n)]
    for host, path, verdict in rules:
        listed[shard(host + path, n)][verdict].add(host + path)
    lengths = sorted({len(p) for _, p, _ in rules}, reverse=True)
    # No url has more keys than suffixes of its host times lengths of paths.
    suffixes = F.size(F.split(F.regexp_extract("url", r"(?s)^.*?://([^/?#]*)", 1), r"\."))
    universe = max(1, (urls.agg(F.sum(suffixes.cast("bigint"))).first()[0] or 0) * max(1, len(lengths)))
    firsts = []
    for own in listed:
        made = {}
        for v, ks in own.items():
            r = max(1, len(ks))
            made[v] = Bloom(r, min(0.5, r * math.sqrt(0.5) * n / universe), 0)
            for k in ks:
                made[v].add(k)
        firsts.append(sc.broadcast(made))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            looked, seen = _Looked(b.column("url").to_pylist(), lengths, n), []
            for i, own in enumerate(loaded(firsts)):
                seen += [(i, v, k) for k in looked.by_shard[i] for v, level in own.items() if k in level]
            cols = list(zip(*seen, strict=True)) if seen else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.string(), pa.string()), strict=True)], ["shard", "verdict", "key"])

    passed: list[dict[str, set[str]]] = [{"allow": set(), "block": set()} for _ in range(n)]
    for row in urls.mapInArrow(go, "shard int, verdict string, key string").distinct().toLocalIterator():
        if row.key not in listed[row.shard][row.verdict]:
            passed[row.shard][row.verdict].add(row.key)
    return [sc.broadcast({v: Cascade.deepen(first.value[v], own[v], let[v]) for v in own}) for first, own, let in zip(firsts, listed, passed, strict=True)]


def judge(pages: DataFrame, rules=RULES, default: str = DEFAULT_VERDICT, shard_rules: int = SHARD_RULES) -> DataFrame:
    """page_id, host, path, rule, verdict for each row of pages (page_id, url)."""
    rules = list(rules)
    lengths = sorted({len(p) for _, p, _ in rules}, reverse=True)
    rows_ = picked(pages, page_id="bigint", url="string")
    shards = build(rows_.select("url"), rules, shard_rules)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            looked, found = _Looked(b.column("url").to_pylist(), lengths, len(shards)), {}
            for i, cascades in enumerate(loaded(shards)):
                for k in looked.by_shard[i]:
                    if k in cascades["block"]:
                        found[k] = "block"
                    elif k in cascades["allow"]:
                        found[k] = "allow"
            rules_ = [next((k for k in own if k in found), None) for own in looked.keys]
            verdicts = [default if k is None else found[k] for k in rules_]
            hosts, paths = zip(*looked.split, strict=True) if looked.split else ((), ())
            yield pa.RecordBatch.from_arrays([b.column("page_id"), *(pa.array(c, pa.string()) for c in (hosts, paths, rules_, verdicts))], ["page_id", "host", "path", "rule", "verdict"])

    return rows_.mapInArrow(go, "page_id bigint, host string, path string, rule string, verdict string")


def op8_url_bloom_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


SQL = """
WITH parts AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*(/[^?#]*)?', 1) AS path
  FROM parts
), rules(h, p, v) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), fits AS (
  SELECT page_id, host, path, h || p AS rule, v FROM split
  JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
), best AS (
  SELECT page_id, max_by(rule, length(rule)) AS rule, max_by(v, length(rule)) AS v FROM fits GROUP BY page_id
)
SELECT split.page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM split LEFT JOIN best USING (page_id)
"""
