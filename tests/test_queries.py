"""Every registered query with SQL gives the rows of that SQL in DuckDB."""

import math

import duckdb
import pytest

from lexmill import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return v


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    got = registry.queries()[name](spark, DATA)
    want = duck.sql(registry.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    places = [want.columns.index(c) for c in columns]
    rows = sorted(repr([plain(r[c]) for c in columns]) for r in got.collect())
    assert rows == sorted(repr([plain(r[i]) for i in places]) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert registry.queries()[name](spark, DATA).count() > 0


def test_round_trip_of_ids(spark):
    assert registry.queries()["bpe_round_trip"](spark, DATA).where("not same or n < 2").count() == 0


def test_shuffled_rows_are_in_the_seed_s_order(spark):
    from pyspark.sql import functions as F

    rows = [r.doc_id for r in registry.queries()["shuffled_documents"](spark, DATA).collect()]
    turn = {r.doc_id: r.t for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", F.xxhash64("doc_id", F.lit(5)).alias("t")).collect()}
    assert rows == sorted(turn, key=lambda i: (turn[i], i)) != sorted(rows)


@pytest.fixture(scope="module")
def uneven(tmp_path_factory):
    """Documents in six files, each greater than the one before: Spark reads the greatest first."""
    folder = tmp_path_factory.mktemp("uneven")
    (folder / "documents.parquet").mkdir()
    for i in range(6):
        duckdb.sql(f"SELECT * FROM '{DATA}/documents.parquet' WHERE doc_id >= {i * i * 5} AND doc_id < {(i + 1) ** 2 * 5} ORDER BY doc_id").write_parquet(str(folder / f"documents.parquet/{i}.parquet"))
    return str(folder)


def differing(spark, name, folder):
    """How many rows the query and its SQL have over documents of several files, and how many differ."""
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    want = c.sql(registry.oracle_sql()[name])
    got = {tuple(r) for r in registry.queries()[name](spark, folder).select(*want.columns).collect()}
    rows = set(want.fetchall())
    return len(rows), len(got ^ rows)


def test_indexed_lines_of_files_that_are_read_out_of_order(spark, uneven):
    assert differing(spark, "indexed_lines", uneven) == (180, 0)


def test_numbered_lines_of_files_that_are_read_out_of_order(spark, uneven):
    assert differing(spark, "numbered_lines", uneven) == (180, 0)
