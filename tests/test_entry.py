"""The registry with and without the training-data operators."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
NAMES = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), *[n for n in e.queries() if n == 'pipeline' or n.startswith('op')])"


def registered(folder: Path) -> list[str]:
    return subprocess.run([sys.executable, "-B", "-c", NAMES], cwd=folder, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(folder)}, capture_output=True, text=True, check=True).stdout.split()


def copy(to: Path, *without: str) -> Path:
    shutil.copytree(ROOT, to, ignore=shutil.ignore_patterns(".git", "__pycache__", "tests", *without))
    return to


def test_registry_without_the_training_data_folders(tmp_path):
    for i, without in enumerate((("llm", "corpus_pipeline.py"), ("llm",))):
        names = registered(copy(tmp_path / str(i), *without))
        assert int(names[0]) >= 55 and int(names[1]) >= 50 and names[2:] == []


def test_nothing_else_imports_the_training_data_folder():
    for file in (ROOT / "quillspark").rglob("*.py"):
        if "llm" not in file.relative_to(ROOT / "quillspark").parts:
            text = file.read_text()
            assert "from .llm" not in text and "quillspark.llm" not in text and "import llm" not in text and "corpus_pipeline" not in text
