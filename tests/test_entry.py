"""The entry points without a session, and without the optional text part."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
CODE = "import __spark_entry__ as e; print(sorted(e.queries())); assert set(e.oracle_sql()) <= set(e.queries())"


def names(folder) -> str:
    out = subprocess.run([sys.executable, "-B", "-c", CODE], cwd=folder, capture_output=True, text=True, timeout=120)
    assert not out.returncode, out.stderr[-1500:]
    return out.stdout


def test_entry_imports_without_a_session():
    assert "e3_triage" in names(ROOT)


def test_entry_works_without_the_text_part(tmp_path):
    for name in ("graphev", "__spark_entry__.py"):
        copy = shutil.copytree if (ROOT / name).is_dir() else shutil.copy
        copy(ROOT / name, tmp_path / name, **({"ignore": shutil.ignore_patterns("llm", "__pycache__")} if (ROOT / name).is_dir() else {}))
    said = names(tmp_path)
    assert "e3_triage" in said and "op1_" not in said and "pipeline" not in said
