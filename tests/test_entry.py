import pytest

import __spark_entry__ as entry

D = "/root/testdata/sf0.001"


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["p1_found", "p2_found", "p3_found", "p3_types", "s6_csv_to_fasta", "a1_weights", "a4_pair_correlations", "t3_frequent_pairs", "w2_gauge_fields", "a9_energies", "r3_shuffled_columns"])
def test_queries_equal_their_sql(spark, name):
    import glob
    import os

    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{D}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    got = entry.queries()[name](spark, D).toPandas()
    want = con.execute(entry.oracle_sql()[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = lambda f: sorted(map(tuple, f[cols].astype(object).where(f[cols].notna(), None).values.tolist()), key=str)
    assert rows(got) == rows(want)
