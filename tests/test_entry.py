"""The driver contract with and without the training-text part."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
COUNT = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), 'pipeline' in e.queries())"


def copied(tmp_path):
    shutil.copytree(ROOT / "catalogloom", tmp_path / "catalogloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    return tmp_path


def run(folder):
    return subprocess.run([sys.executable, "-c", COUNT], cwd=folder, env={"PATH": "/usr/bin:/bin"}, capture_output=True, text=True)


def test_without_the_training_text_part(tmp_path):
    from catalogloom.driver.registry import ALL

    done = run(copied(tmp_path))
    assert done.stdout.split() == [str(len(ALL)), str(len(ALL)), "False"], done.stderr


def test_a_broken_part_is_an_error(tmp_path):
    folder = copied(tmp_path)
    (folder / "catalogloom" / "llm").mkdir()
    (folder / "catalogloom" / "llm" / "__init__.py").write_text("")
    (folder / "catalogloom" / "llm" / "queries.py").write_text("import no_such_module\n")
    (folder / "corpus_pipeline.py").write_text("run, ORACLE_SQL = None, None\n")
    done = run(folder)
    assert done.returncode and "no_such_module" in done.stderr
