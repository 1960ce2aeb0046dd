"""The driver's contract."""

from __future__ import annotations

import ast
from pathlib import Path

import pytest

import __spark_entry__ as entry
from tests.oracle import DATA

ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are not here")
def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and {"note", "similarity"} <= set(df.columns)


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_else_imports_the_preparation_folder():
    for path in (ROOT / "corvane").rglob("*.py"):
        if "llm" in path.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any(n.startswith("corvane.llm") for n in names), path
