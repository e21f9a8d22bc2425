"""Every query of this folder that SQL can say, against that SQL."""

import pytest
from compare import connection, difference

from parcelspan.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, folder, name):
    assert difference(QUERIES[name](spark, folder), connection(folder), SQL[name]) is None
