"""Queries read their whole tables, and their SQL does too."""

import pytest

from emberframe.plans import registry, tables

SF = "/root/testdata/sf0.01"


def rows(df):
    from test_queries import rows as own

    return own(df)


@pytest.mark.parametrize("name", [n for n in registry.oracle_sql() if n.startswith(("t1", "t2", "g1", "g2"))])
def test_against_sql_of_the_next_size(spark, name):
    import glob
    import os

    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    assert rows(registry.queries()[name](spark, SF).toPandas()) == rows(con.execute(registry.oracle_sql()[name]).df())


def test_no_sql_cuts_its_tables():
    assert not [n for n, sql in registry.oracle_sql().items() if "movie_id <" in sql or "pos < 12" in sql]


def test_every_event_is_a_point(spark):
    from pyspark.sql import functions as F

    assert tables.polygons(spark, SF).agg(F.sum(F.size("pts"))).first()[0] == tables.read(spark, SF, "events").count()
