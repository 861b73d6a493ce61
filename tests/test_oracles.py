"""Every registered query against its DuckDB oracle at the smallest scale."""

import pytest

import check
from sheaf.plans import registry

QUERIES, ORACLES = registry.queries(), registry.oracles()


@pytest.fixture(scope="module")
def con(sf):
    return check.connect(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf, name):
    rows, verdict = check.compare(spark, con, name, QUERIES[name], ORACLES.get(name), sf)
    assert verdict in ("ok", "rows-only"), verdict[:600]


def test_registry_is_complete():
    assert set(ORACLES) <= set(QUERIES)
    families = {n.split("_")[0] for n in QUERIES}
    wanted = (
        {f"r{i}" for i in range(1, 13)} | {f"t{i}" for i in range(1, 14)} | {f"l{i}" for i in range(1, 19)}
        | {f"f{i}" for i in range(1, 17)} | {f"x{i}" for i in range(1, 9)} | {f"p{i}" for i in range(1, 10)}
        | {f"w{i}" for i in range(1, 7)} | {f"c{i}" for i in range(1, 6)} | {f"s{i}" for i in range(1, 8)} | {"st1", "st2", "k1", "k2"}
    )
    assert wanted <= families
