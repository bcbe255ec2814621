"""The driver entry imports and keeps its contract."""

import __spark_entry__ as entry


def test_contract():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 40
    assert all(callable(q) for q in queries.values())


def test_nothing_imports_the_optional_package():
    import pathlib

    root = pathlib.Path(entry.__file__).parent / "quarry"
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "quarry.llm" not in path.read_text()
