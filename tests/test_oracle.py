"""Every registered query against its SQL twin on the smallest data set."""

import pytest

from oracle import compare, connect
from shotweave.queries import load_all

SF = "/root/testdata/sf0.001"
# the ten suppliers of the smallest set claim no digit twice, so this query has rows only at the next size
LARGER = {"i10_upsert_groups_conflicts": "/root/testdata/sf0.01"}
QUERIES = load_all()


@pytest.fixture(scope="module")
def cons():
    return {sf: connect(sf) for sf in {SF, *LARGER.values()}}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, cons, name):
    fn, sql = QUERIES[name]
    sf = LARGER.get(name, SF)
    status, n, _, info = compare(spark, cons[sf], sf, name, fn, sql)
    assert status in ("ok", "rows-only"), info
    assert n > 0
