import ast
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from compare import canonical
from folioforge.plans import catalog

DATA = Path("/root/testdata/sf0.001")
ROOT = Path(__file__).resolve().parent.parent


@pytest.fixture(scope="module")
def con():
    if not DATA.exists():
        pytest.skip("no test data")
    found = duckdb.connect()
    for f in DATA.iterdir():
        found.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return found


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, con, name):
    df = catalog.QUERIES[name](spark, str(DATA))
    want = con.execute(catalog.SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert canonical(df.columns, df.collect()) == canonical(columns, want.fetchall())


def test_entry(spark):
    if DATA.exists():
        assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_imports_the_training_text_subpackage():
    for path in (ROOT / "folioforge").rglob("*.py"):
        if "llm" in path.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any(n.startswith("folioforge.llm") for n in names), path
