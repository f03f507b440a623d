"""Checkpoints, bounded tables, and that nothing needs the subpackage for training data."""

import ast
from pathlib import Path

import pytest

from wayfold import runtime as R

ROOT = Path(__file__).resolve().parents[1]


def test_checkpoint_folder(spark):
    there = R.ensure_checkpoint_dir(spark)
    assert there and R.ensure_checkpoint_dir(spark) == spark.sparkContext.getCheckpointDir()
    df = R.cut(spark.range(5))
    assert df.count() == 5 and "Range" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_bounded_rows(spark):
    assert len(R.bounded_rows(spark.range(3), 3, "x")) == 3
    with pytest.raises(ValueError):
        R.bounded_rows(spark.range(4), 3, "x")


def test_nothing_imports_the_training_data_package():
    for p in (ROOT / "wayfold").rglob("*.py"):
        if "llm" in p.relative_to(ROOT).parts:
            continue
        for n in ast.walk(ast.parse(p.read_text())):
            names = [a.name for a in n.names] if isinstance(n, ast.Import) else [n.module or ""] if isinstance(n, ast.ImportFrom) else []
            assert not any(x.startswith("wayfold.llm") for x in names), p
