"""Every core query with an SQL equivalent gives its rows on the smallest tables."""

from __future__ import annotations

import pytest

from wayfabric.queries import FLAGSHIP, ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, same_rows, name):
    same_rows(QUERIES[name](spark, SF), duck, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - {FLAGSHIP}))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_flagship_identities(spark):
    rows = QUERIES[FLAGSHIP](spark, SF).orderBy("step").collect()
    assert [r["step"] for r in rows] == list(range(9))
    assert rows[0]["resilience_index"] == 1.0 and rows[0]["removed_node"] is None
    for r in rows[1:]:
        assert r["resilience_index"] > 0
        assert abs(r["resilience_index"] - rows[0]["avg_path_len"] / r["avg_path_len"]) < 1e-3


def test_entry_contract():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert set(entry.oracle_sql()) <= names and FLAGSHIP in names
