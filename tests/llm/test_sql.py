import pytest

from rowgrove.llm.queries import ORACLES, QUERIES
from tests.oracle import connect, same


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(name, spark, sf_dir):
    same(QUERIES[name](spark, sf_dir), connect(sf_dir), ORACLES[name])


def test_ten_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))


def test_nothing_else_imports_the_subpackage():
    from pathlib import Path

    import rowgrove

    root = Path(rowgrove.__file__).parent
    others = [f for f in root.rglob("*.py") if "llm" not in f.relative_to(root).parts]
    assert others and not [f for f in others if "llm" in f.read_text()]
