from __future__ import annotations

import __spark_entry__ as entry


def test_contract(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "header_ok" in df.columns
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_engine_stands_without_the_other_subpackage():
    import ast
    from pathlib import Path

    root = Path(entry.__file__).parent / "tallyweave"
    for f in root.rglob("*.py"):
        if "llm" not in f.parts:
            names = [n.module or "" for n in ast.walk(ast.parse(f.read_text())) if isinstance(n, ast.ImportFrom)] + [a.name for n in ast.walk(ast.parse(f.read_text())) if isinstance(n, ast.Import) for a in n.names]
            assert not any("llm" in n.split(".") for n in names), f
