"""Line dedup with DataFrame functions only: explode normalised lines, hash, count documents for each hash, drop, reassemble.

A line's key is the line without `[\\x20\\x09-\\x0D]` at its ends and with A-Z lower-cased. Keys of at least
`min_chars` code points that stand in at least `min_docs` documents lose all their lines, except in the largest
doc_id that holds them. What is left keeps its position and is joined by newlines.

Long enough lines are exploded with their positions; keys travel as two 64-bit hashes (128 bits), never as text. A key
that a third of all documents hold is counted in two steps: distinct (key, document) pairs, which spread over tasks by
both, then counts summed before the shuffle; the join of lines to the keys that lose lines is one that adaptive execution
splits where it is skewed. Each text crosses the network once, to meet the positions that it loses, and is put together
from the runs of lines between them, in time that grows with its number of lines only.

Defined cases: a null or empty text is one empty line and keeps its value; documents with a null doc_id keep all
lines and count for no key; rows that repeat a doc_id are one document and lose the same lines; a text that loses
all lines is empty; texts may have any number of lines; an empty table gives no rows; all other columns are kept,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, picked, table

MIN_CHARS = 20
MIN_DOCS = 3
_BLANKS = " \t\n\x0b\x0c\r"


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(_BLANKS)))


def lost(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """For each text that loses lines, their places: doc_id, own (a hash of the text), gone (sorted, from 0); docs: doc_id, text, own."""
    numbered = F.transform(lines(F.col("text")), lambda x, i: F.struct(i.alias("at"), x.alias("line")))
    # Only the lines that can have a key long enough are normalised.
    long_ = F.filter(numbered, lambda x: F.char_length(x["line"]) >= min_chars)
    rows = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "own", F.explode(long_).alias("l"))
    keyed = rows.select("doc_id", "own", F.col("l.at").alias("at"), key(F.col("l.line")).alias("key")).where(F.char_length("key") >= min_chars)
    held = keyed.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc_id", "own", "at").repartition("h1", "h2", "doc_id")
    counts = held.select("h1", "h2", "doc_id").distinct().groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper"))
    hot = counts.where(F.col("n") >= min_docs).select("h1", "h2", "keeper")
    out = held.join(hot, ["h1", "h2"]).where(F.col("doc_id") < F.col("keeper"))
    return out.groupBy("doc_id", "own").agg(F.sort_array(F.collect_list("at")).alias("gone"))


def _rest(all_: Column, gone: Column) -> Column:
    """The lines that aren't at the places `gone`: the runs before each of them, and after the last."""
    before = F.concat(F.array(F.lit(-1)), gone)
    upto = F.concat(gone, F.array(F.size(all_)))
    return F.flatten(F.zip_with(before, upto, lambda a, z: F.slice(all_, a + 2, z - a - 1)))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, numbers: str | None = None) -> DataFrame:
    """docs with the lines dropped from `text`; numbers: a further column (struct n_lines, n_dropped) of that name."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    ident, text = (names[docs.columns.index(c)] for c in ("doc_id", "text"))
    plain = docs.toDF(*names).withColumn("own", F.xxhash64(F.col(text).cast("string")))
    losing = lost(plain.select(F.col(ident).alias("doc_id"), F.col(text).alias("text"), "own"), min_chars, min_docs).select(F.col("doc_id").alias("lost_id"), F.col("own").alias("lost_own"), "gone")
    # The side with places is the smaller one in each partition; texts needn't be sorted for a hash join.
    joined = plain.join(losing.hint("shuffle_hash"), (F.col(ident) == F.col("lost_id")) & (F.col("own") == F.col("lost_own")), "left")
    all_, none = lines(F.col(text)), F.col("gone").isNull()
    kept = F.when(none, F.col(text)).otherwise(F.array_join(_rest(all_, F.col("gone")), "\n"))
    cols = [kept.alias(c) if c == text else F.col(c) for c in names]
    if numbers:
        cols.append(F.struct(F.size(all_).cast("bigint").alias("n_lines"), F.when(none, F.lit(0)).otherwise(F.size("gone")).cast("bigint").alias("n_dropped")))
    return joined.select(*cols).toDF(*docs.columns, *([numbers] if numbers else []))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(picked(table(spark, sf_dir, "documents"), doc_id="bigint", text="string"), numbers="lines")
    return out.select(
        "doc_id",
        F.col("lines.n_lines").alias("n_lines"),
        F.col("lines.n_dropped").alias("n_dropped"),
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"),
    )


SQL = """
WITH split AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM split
), hot AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20
  GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT keyed.*, coalesce(keeper <> doc_id, false) AS dropped FROM keyed LEFT JOIN hot USING (k)
)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (dropped) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
