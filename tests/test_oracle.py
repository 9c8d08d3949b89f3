"""Every registered query with an oracle equals its DuckDB SQL (sf0.001)."""

import pytest

import __spark_entry__ as entry_module
from offerlake.plans import catalog as E  # the corpus queries have tests of their own
from tests.conftest import SF_SMALL
from tools.check_oracle import rows_of, type_class

KEYS = sorted(E.oracle_sql())


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, duck, key):
    s_tbl = E.queries()[key](spark, SF_SMALL).toArrow()
    d_tbl = duck.sql(E.oracle_sql()[key]).arrow()
    if hasattr(d_tbl, "read_all"):
        d_tbl = d_tbl.read_all()
    assert sorted(s_tbl.column_names) == sorted(d_tbl.column_names)
    for n in s_tbl.column_names:
        assert type_class(s_tbl.schema.field(n).type) == type_class(d_tbl.schema.field(n).type), n
    assert s_tbl.num_rows == d_tbl.num_rows
    assert rows_of(s_tbl) == rows_of(d_tbl)


def test_every_query_has_a_spark_plan(spark):
    qs = E.queries()
    assert set(E.oracle_sql()) <= set(qs)
    assert len(qs) >= 85


def test_every_query_has_an_oracle():
    assert set(E.oracle_sql()) == set(E.queries())


def test_entry_smoke(spark):
    df = entry_module.entry(spark)
    assert df.count() > 0
    assert "date" in df.columns
