"""The driver's entry point with and without the llm folders, and with a part of them missing."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

TOP = Path(__file__).resolve().parent.parent
SAY = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), 'pipeline' in e.queries())"


@pytest.fixture
def copy(tmp_path):
    for name in ("cueloom", "__spark_entry__.py", "corpus_pipeline.py"):
        if (TOP / name).is_dir():
            shutil.copytree(TOP / name, tmp_path / name, ignore=shutil.ignore_patterns("__pycache__"))
        elif (TOP / name).exists():
            shutil.copy(TOP / name, tmp_path / name)
    return tmp_path


def run(folder):
    return subprocess.run([sys.executable, "-c", SAY], cwd=folder, capture_output=True, text=True, timeout=120, env={"PATH": "/usr/bin:/bin", "HOME": str(folder)})


def test_without_the_llm_folders(copy):
    shutil.rmtree(copy / "cueloom" / "llm", ignore_errors=True)
    (copy / "corpus_pipeline.py").unlink(missing_ok=True)
    from cueloom.plans import queries, sql

    assert run(copy).stdout.split() == [str(len(queries.queries())), str(len(sql.oracle_sql())), "False"]


def test_a_missing_package_is_an_error(copy):
    if not (copy / "corpus_pipeline.py").exists():
        pytest.skip("the llm folders are absent")
    assert run(copy).stdout.split()[2] == "True"
    path = copy / "cueloom" / "llm" / "common.py"
    path.write_text(path.read_text().replace("from pyspark.sql import Column", "import a_package_that_is_not_there\nfrom pyspark.sql import Column", 1))
    done = run(copy)
    assert done.returncode != 0 and "a_package_that_is_not_there" in done.stderr
