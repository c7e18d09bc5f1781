"""What several operators share: reading tables, cutting lineage, word tables of bytes."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Maps A-Z to a-z and every byte that is in no word (`[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`) to a blank.
WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that spark.checkpoint.dir names. Where it is unset, a folder of our own, in local mode only."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="keyhound-checkpoint-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint, which survives lost executors.

    What came before is then out of use: the driver collects its plans, so that Spark's cleaner removes their shuffle
    files and older checkpoints now and not when the driver's memory happens to run low.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    out = df.checkpoint(eager=True)
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return out


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased and nothing else; texts of one byte a character take the fast path."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, upper, upper.lower()))


def utf8(texts) -> list[bytes]:
    """The texts of an Arrow column as bytes; null is empty."""
    return [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts.to_pylist()]


def picked(df: DataFrame, **names: str) -> DataFrame:
    """The named columns alone, by position, so that other columns may have any name; a further name is found in any case."""
    at = {c: i for i, c in reversed([*enumerate(df.columns)])}
    lower = {c.lower(): i for i, c in reversed([*enumerate(df.columns)])}
    plain = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    return plain.select(*(F.col(f"c{at.get(name, lower.get(name.lower()))}").cast(kind).alias(name) for name, kind in names.items()))


def loaded(shards: list) -> Iterator:
    """The values of broadcasts, one after another; of several only one at a time is in memory."""
    for s in shards:
        yield s.value
        if len(shards) > 1:
            s.__dict__.pop("_value", None)


#: What this worker keeps between tasks: one operator's state, by its key.
_kept: dict = {}


def kept(key: tuple, make):
    """The state of this key, made where the worker doesn't have it; what any other operator kept goes first."""
    if key not in _kept:
        vacated()
        _kept[key] = make()
    return _kept[key]


def vacated() -> None:
    """Frees what other operators' tasks left in this worker; an operator that keeps nothing begins its tasks with it."""
    if _kept:
        _kept.clear()
        released()


def released() -> None:
    """Hands freed memory back to the system, for which the allocators otherwise keep it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)
