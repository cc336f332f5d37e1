"""The library stands without its llm folders, and nothing else reaches into them."""

import os
import pathlib
import re
import shutil
import subprocess
import sys

ROOT = pathlib.Path(__file__).resolve().parent.parent


def test_nothing_else_imports_llm():
    for path in (ROOT / "terrafold").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert not re.search(r"terrafold\.llm|from \.llm|import llm", path.read_text()), path


def test_the_rest_imports_without_llm(tmp_path):
    skip = shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__")
    shutil.copytree(ROOT, tmp_path / "repo", ignore=skip)
    code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); assert 'pipeline' not in q; print(len(q))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", env=env, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    assert int(out.stdout) > 100
    run = [sys.executable, "-m", "pytest", "-q", "-p", "no:cacheprovider", "tests/test_rules.py", "tests/test_queries.py::test_entry_has_rows"]
    out = subprocess.run(run, cwd=tmp_path / "repo", env=env, capture_output=True, text=True, timeout=600)
    assert out.returncode == 0, out.stdout[-2000:]
    out = subprocess.run([*run[:4], "--collect-only", "tests"], cwd=tmp_path / "repo", env=env, capture_output=True, text=True, timeout=600)
    assert out.returncode == 0, out.stdout[-2000:]


def test_no_local_checkpoint_and_no_cross_join():
    for path in [*(ROOT / "terrafold").rglob("*.py"), ROOT / "corpus_pipeline.py"]:
        if path.exists():
            assert not re.search(r"\.localCheckpoint\(|\.crossJoin\(|CROSS JOIN", path.read_text()), path
