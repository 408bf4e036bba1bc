"""The subpackage's queries against their SQL."""

import pytest

from tarn.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_as_sql(name, same_as_sql):
    same_as_sql(queries.QUERIES[name], queries.ORACLES[name])
