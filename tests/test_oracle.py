"""Every registered query with oracle SQL equals DuckDB on the sf0.001 tables."""

import pytest

from tables import SF_SMALL
from oracle_compare import compare


def test_registered_queries_match_oracle(spark):
    res = compare(spark, SF_SMALL, verbose=False)
    bad = {k: v for k, v in res.items() if v not in ("ok", "no-oracle")}
    assert not bad, bad
    assert sum(1 for v in res.values() if v == "ok") >= 49
