import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(entry.__file__).parent


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["word", "n"] and df.count() == 100


def test_sql_names_are_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_imports_without_the_optional_folders(tmp_path):
    """A copy without the training-data folders still imports and keeps the other queries."""
    import shutil

    shutil.copytree(ROOT / "textquarry", tmp_path / "textquarry", ignore=lambda d, names: ["llm"] if d.endswith("textquarry") else [])
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'word_top100' in q and 'pipeline' not in q and not any(k.startswith('op1') for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"})
