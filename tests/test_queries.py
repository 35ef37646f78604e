"""Every query of the plans against its SQL."""

from __future__ import annotations

import oracle
import pytest

import __spark_entry__ as entry
from heliograph.plans import queries as plans


@pytest.fixture(scope="module")
def db(small):
    return oracle.connect(small)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, small, db, name):
    found = plans.QUERIES[name](spark, small)
    if name in plans.ORACLES:
        assert oracle.difference(found, db, plans.ORACLES[name]) == ""
    else:
        assert found.count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() >= 0
    assert set(plans.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_whole_texts_are_classified(spark, tmp_path):
    spark.createDataFrame([(1, 0, "user", "a long request that goes on and on f/2.8")], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert plans.QUERIES["classify_query"](spark, str(tmp_path)).first()["aperture"] == pytest.approx(2.8)
