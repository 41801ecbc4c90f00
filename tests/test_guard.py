"""The library and its entry file work without the corpus subpackage."""

import os
import re
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def entry_of(folder, code):
    env = os.environ | {"PYTHONPATH": str(folder), "PYTHONDONTWRITEBYTECODE": "1"}
    return subprocess.run([sys.executable, "-c", code], cwd=folder, env=env, capture_output=True, text=True, timeout=120)


def copy_without(tmp_path, *gone):
    for item in ("quirelake", "__spark_entry__.py", "corpus_pipeline.py"):
        source = ROOT / item
        if source.is_dir():
            shutil.copytree(source, tmp_path / item, ignore=shutil.ignore_patterns("__pycache__"))
        elif source.exists():
            shutil.copy(source, tmp_path / item)
    for item in gone:
        path = tmp_path / item
        shutil.rmtree(path) if path.is_dir() else path.unlink(missing_ok=True)


NAMES = "import __spark_entry__ as e; print(*e.queries()); assert set(e.oracle_sql()) <= set(e.queries())"


def test_entry_without_the_subpackage(tmp_path):
    for gone in (("quirelake/llm", "corpus_pipeline.py"), ("quirelake/llm",)):
        shutil.rmtree(tmp_path / "quirelake", ignore_errors=True)
        copy_without(tmp_path, *gone)
        out = entry_of(tmp_path, NAMES)
        assert out.returncode == 0, out.stderr
        names = out.stdout.split()
        assert "formula_outside_table" in names and not [n for n in names if re.match(r"op\d+_|pipeline$", n)]


def test_other_import_errors_are_not_hidden(tmp_path):
    copy_without(tmp_path, "quirelake/schema.py")
    assert entry_of(tmp_path, NAMES).returncode != 0


def test_nothing_else_imports_the_subpackage():
    for path in (ROOT / "quirelake").rglob("*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"import.*\bllm\b|from.*\bllm\b", path.read_text()), path
