"""Every registered query beside its SQL, on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
from workload import queries
from workload.compare import check, database
from workload.oracles import ORACLES

SF_DIR = "/root/testdata/sf0.001"
QUERIES = queries.QUERIES


@pytest.fixture(scope="module")
def con():
    return database(SF_DIR)


@pytest.fixture(scope="module", autouse=True)
def one_token_table(spark):
    """Store the token table once for all tests."""
    stored = queries.stored_tokens(spark, SF_DIR)
    patch = pytest.MonkeyPatch()
    patch.setattr(queries, "stored_tokens", lambda *_: stored)
    yield
    patch.undo()


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES)
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLES) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    result = check(spark, con, SF_DIR, name)
    assert result.startswith("ok") and "[" not in result, result
    assert not result.startswith("ok 0 rows"), result


def test_fields_are_not_all_defaults(spark):
    rows = QUERIES["records"](spark, SF_DIR).collect()
    for field in ("time_anchor", "situations", "thoughts", "emotions", "reactions", "triggers"):
        assert len({r[field] for r in rows}) > 5 or field in ("time_anchor", "emotions")
        assert len({r[field] for r in rows}) > 2


def test_entry(spark):
    rows = contract.entry(spark).collect()
    assert len(rows) == 20 and all(0 <= r.share_positive <= 1 for r in rows)
