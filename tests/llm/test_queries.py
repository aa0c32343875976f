"""Every query of the folder against its SQL, or for rows alone, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from palisade.llm.registry import QUERIES
from tests.compare import connect, differences
from tests.llm.conftest import SF


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df, sql = entry.queries()[name](spark, SF), entry.oracle_sql().get(name)
    if sql:
        assert differences(df, connect(SF), sql) == []
    else:
        assert df.count() > 0
