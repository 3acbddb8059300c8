"""Every registered query with SQL against DuckDB; the others must give rows."""

from pathlib import Path

import pytest
from compare import connect, differences

from tessera.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    if name in registry.ORACLE_SQL:
        assert differences(duck, df, registry.ORACLE_SQL[name]) == ""
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() >= 0
    assert set(registry.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_an_entry_goes_on_without_what_a_part_needs(monkeypatch):
    import sys
    from importlib import reload

    import __spark_entry__ as entry

    monkeypatch.setitem(sys.modules, "zstandard", None)
    for name in [m for m in sys.modules if m.startswith("tessera.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    try:
        import tessera.llm  # noqa: F401
    except ImportError:
        pytest.skip("the part is not there")
    with pytest.warns(UserWarning, match="zstandard"):
        reload(entry)
    assert set(registry.QUERIES) == set(entry.queries()) - {"pipeline"}
    monkeypatch.undo()
    reload(entry)
