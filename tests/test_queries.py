import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from quadrat.plans import catalogue
from quadrat.plans.oracle import SQL

QUERIES = catalogue()
DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, duck, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), duck.execute(SQL[name]).fetch_df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns) and len(got) == len(want)
    a, b = (x[columns].astype(str).sort_values(columns).reset_index(drop=True) for x in (got, want))
    assert a.equals(b)


@pytest.mark.parametrize("name", ["cv_size_report", "kmer_count"])
def test_letters_whose_upper_case_is_two(spark, tmp_path, name):
    """Eszett and others become two letters in Java's upper case, ACGT among them, and one or none in SQL's."""
    texts = ["ßßßßß gattacagat", "gattaca gattaca aaccggtt", "agẗcaﬆacẚgta", None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = c.execute(SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(tuple(r[x] for x in columns) for r in QUERIES[name](spark, str(tmp_path)).collect()) == sorted(want.fetchall())
    texts = ["ß" * 20 + "gattacagat", "gattaca" * 5]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    want = c.execute(SQL[name])
    assert sorted(tuple(r[x] for x in columns) for r in QUERIES[name](spark, str(tmp_path)).collect()) == sorted(want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_other_queries_have_rows(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 200 * 201 // 2
    assert set(entry.oracle_sql()) <= set(entry.queries())
