"""The library without its subpackage ``llm`` and the pipeline."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry_works_without_llm(tmp_path):
    for name in ("__spark_entry__.py", "tidelog"):
        source = ROOT / name
        if source.is_dir():
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(source, tmp_path / name)
    code = "import __spark_entry__ as e; q = e.queries(); s = e.oracle_sql(); assert len(q) > 40 and set(s) == set(q) and 'pipeline' not in q; print('fine')"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.stdout.strip() == "fine", done.stderr


def test_nothing_imports_llm():
    for path in (ROOT / "tidelog").rglob("*.py"):
        if "llm" not in path.parts:
            assert "tidelog.llm" not in path.read_text(), path
