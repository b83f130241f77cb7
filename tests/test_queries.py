"""Every query of the catalog runs, and equals its SQL."""

import pytest

from tests.compare import duck, same
from tidemark.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, con, name):
    df = catalog.queries()[name](spark, SF)
    if name in catalog.oracle_sql():
        same(df, con, catalog.oracle_sql()[name])
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_pair_counts_of_the_recording(spark):
    """Windows above 0.32 by pair, known from an independent run."""
    found = catalog.discoveries_by_edge(spark, SF).toPandas().set_index("edge")["n"]
    names = dict(zip(catalog.EVENT_OF.values(), catalog.EVENT_OF, strict=True))
    want = {("view", "click"): 93, ("view", "purchase"): 82, ("view", "error"): 121, ("click", "purchase"): 187, ("click", "error"): 170, ("purchase", "error"): 122}
    assert {k: int(found[f"{names[k[0]]}->{names[k[1]]}"]) for k in want} == want
