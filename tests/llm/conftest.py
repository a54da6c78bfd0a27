import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from oddities import SCHEMA, odd_rows  # noqa: E402


@pytest.fixture(scope="session")
def odd(spark):
    """The odd documents with columns whose names operators use themselves."""
    sources = [None, "a", "b", "é", "a", "a"]
    full = [(i, t, None if k % 4 == 0 else "en", sources[k % 6], None if k % 5 == 0 else len(t or ""), k, k, k, 0.5, "x", k, "y")
            for k, (i, t) in enumerate(odd_rows())]
    return spark.createDataFrame(full, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def pairs(odd):
    return [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]


def table(rows):
    """Rows in an order that does not depend on how they came."""
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is not None, str(x)) for x in r))


@pytest.fixture(scope="session")
def same():
    def check(got, expected):
        assert table(got) == table(expected)
    return check
