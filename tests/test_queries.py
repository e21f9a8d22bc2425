"""Every registered query against its SQL in an independent engine."""

import uuid
from concurrent.futures import ThreadPoolExecutor

import pytest
from compare import connection, difference

from parcelspan.plans.inputs import Inputs
from parcelspan.plans.registers import EVENT_NAMESPACE
from parcelspan.plans.registry import all_queries, all_sql

QUERIES, SQL = all_queries(), all_sql()


@pytest.fixture(scope="module")
def differences(spark, folder):
    """What differs, per query. The tables are small and the time goes into planning, so queries run side by side."""
    con = connection(folder)

    def one(name):
        df = QUERIES[name](spark, folder)
        return difference(df, con.cursor(), SQL[name]) if name in SQL else (None if df.count() else "no rows")

    with ThreadPoolExecutor(6) as pool:
        return {name: pool.submit(one, name) for name in QUERIES}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(differences, name):
    assert differences[name].result() is None


def test_event_uuid_is_a_version_5_uuid(spark, folder):
    rows = Inputs(spark, folder).scans().join(QUERIES["event_uuid"](spark, folder), "event_id").collect()
    for row in rows[:200]:
        assert row["event_uuid"] == str(uuid.uuid5(EVENT_NAMESPACE, f"{row['route_id']}/{row['order_id']}/{row['status']}"))


def test_entry_has_the_waves(spark):
    import __spark_entry__

    assert {r["wave"] for r in __spark_entry__.entry(spark).collect()} == {"morning", "afternoon", "all"}
