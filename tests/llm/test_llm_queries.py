"""Every query of the subpackage against its SQL; those without SQL run."""

import compare
import pytest

from tidemark.llm import queries as Q


@pytest.mark.parametrize("name", list(Q.QUERIES))
def test_query(name, spark, data, duck, vocabularies):
    if name in Q.ORACLES:
        assert compare.differences(spark, duck, data, Q.QUERIES[name], Q.ORACLES[name]) == ""
    else:
        assert Q.QUERIES[name](spark, data).count() > 0
