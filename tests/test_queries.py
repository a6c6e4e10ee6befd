"""Every query of the library against its SQL."""

import pytest

from atlas.plans import catalogue
from tests.conftest import rows

EMPTY = {"link_manual"}


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_equals_sql(spark, duck, sf_dir, name):
    mine = catalogue.queries()[name](spark, sf_dir).toPandas()
    other = duck.sql(catalogue.oracle_sql()[name]).df()
    assert sorted(mine.columns) == sorted(other.columns)
    assert len(mine) > 0
    assert rows(mine) == rows(other)


def test_entry_has_all_queries(spark):
    import __spark_entry__ as entry

    assert set(catalogue.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 10


def test_first_match_takes_the_first_row_of_the_table(spark, duck, tmp_path):
    """Repeated lines, in files that Spark deals out by size."""
    (tmp_path / "lineitem.parquet").mkdir()
    duck.sql(f"COPY (SELECT range p_partkey FROM range(1000)) TO '{tmp_path}/part.parquet'")
    for k in range(4):  # the first file is the smallest, so its rows come last
        duck.sql(f"COPY (SELECT range % 50 l_orderkey, 1 l_linenumber, 200 + (range * 37 + {k}) % 800 l_partkey, 2000 + range l_suppkey FROM range({50 * (k * 20 + 1)})) TO '{tmp_path}/lineitem.parquet/{k}.parquet'")
    got = {r.l_orderkey: r.p_partkey for r in catalogue.queries()["import_first_match"](spark, str(tmp_path)).collect()}
    first = duck.sql(f"SELECT l_orderkey, l_partkey FROM '{tmp_path}/lineitem.parquet/0.parquet'").fetchall()
    assert got == dict(first) and len(first) == 50
