"""Every query with SQL gives the rows of that SQL."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


@pytest.fixture(scope="module")
def tables():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if not n.startswith("op") and n != "pipeline"))
def test_rows_equal_sql(spark, tables, name):
    df = entry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    want = tables.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in cols)} FROM ({entry.oracle_sql()[name]})").fetchall()
    got = [tuple(r) for r in df.select(*[f"`{c}`" for c in cols]).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_the_flagship_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_a_stream_reads_one_file_and_folders_of_files(spark, tmp_path):
    larger = DATA.replace("sf0.001", "sf0.01")  # with tokens in it
    d = spark.read.parquet(f"{larger}/documents.parquet")
    d.coalesce(1).write.parquet(f"{tmp_path}/one")
    (part,) = (tmp_path / "one").glob("part-*")
    for name in ("file", "parts", "dealt"):
        (tmp_path / name / "other.parquet").mkdir(parents=True)
        (tmp_path / name / "other.parquet" / "documents.parquet").write_bytes(part.read_bytes())
    (tmp_path / "file" / "documents.parquet").write_bytes(part.read_bytes())
    d.repartition(3).write.parquet(f"{tmp_path}/parts/documents.parquet")
    d.write.partitionBy("lang").parquet(f"{tmp_path}/dealt/documents.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{larger}/documents.parquet'")
    want = sorted(c.execute(entry.oracle_sql()["stream_scan"]).fetchall())
    assert want
    for name in ("file", "parts", "dealt"):
        got = entry.queries()["stream_scan"](spark, f"{tmp_path}/{name}").collect()
        assert sorted(map(tuple, got)) == want, name
