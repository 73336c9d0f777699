"""Every registered query against its SQL text on the smallest data folder."""

import pytest

from structlake.plans.catalog import load
from structlake.plans.registry import ORACLES, QUERIES
from structlake.plans.verify import compare, duck_connection

load()


@pytest.fixture(scope="module")
def duck(data_folder):
    return duck_connection(data_folder)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, data_folder, duck):
    frame = QUERIES[name](spark, data_folder)
    if name in ORACLES:
        assert compare(frame, duck, ORACLES[name]) is None
    else:
        assert frame.count() > 0
