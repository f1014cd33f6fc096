"""The library without the training-data operators and the pipeline, and the folder of staged tables."""

import os
import shutil
import subprocess
import sys

import pytest

from scrivena.plans import staging

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("gone", [["scrivena/llm", "tests/llm"], ["scrivena/llm", "tests/llm", "corpus_pipeline.py"]])
def test_the_rest_stands_without_what_may_be_deleted(tmp_path, gone):
    copy = tmp_path / "repo"
    shutil.copytree(HERE, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "*.json", "spark-warehouse"))
    for name in gone:
        path = copy / name
        if path.is_dir():
            shutil.rmtree(path)
        elif path.exists():
            path.unlink()
    said = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and set(e.oracle_sql()) <= set(q); assert not any(n.startswith('op') and n[2:3].isdigit() for n in q) and 'pipeline' not in q"
    environment = {**os.environ, "PYTHONPATH": str(copy)}
    subprocess.run([sys.executable, "-c", said], cwd=copy, env=environment, check=True)
    subprocess.run([sys.executable, "-m", "pytest", "tests", "-q", "--collect-only"], cwd=copy, env=environment, check=True, stdout=subprocess.DEVNULL)


def test_other_import_errors_are_not_hidden():
    import __spark_entry__ as entry

    with pytest.raises(ImportError):
        entry._module("scrivena.no_such_module")


def test_staged_tables_can_be_cleared(spark):
    staged = staging.stage(spark.range(3).toDF("n"), "cleared")
    path = staged.inputFiles()[0].removeprefix("file:")
    assert staged.count() == 3 and os.path.exists(path)
    staging.clear(spark)
    assert not os.path.exists(path)
