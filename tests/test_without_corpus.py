"""The package works where the corpus subpackage isn't there."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_imports_without_it(tmp_path):
    shutil.copytree(f"{ROOT}/helixframe", tmp_path / "helixframe", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copytree(f"{ROOT}/jobs", tmp_path / "jobs", ignore=shutil.ignore_patterns("__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(x.startswith('op') for x in q) and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True, timeout=120)


def test_nothing_else_imports_it():
    for folder, _, names in (x for top in ("helixframe", "jobs") for x in os.walk(f"{ROOT}/{top}")):
        if os.path.basename(folder) != "llm":
            for name in names:
                if name.endswith(".py"):
                    text = open(os.path.join(folder, name)).read()
                    assert "llm" not in text, name
