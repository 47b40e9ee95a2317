import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_imports_without_the_optional_part(tmp_path):
    for name in ("quadrille", "__spark_entry__.py"):
        (shutil.copytree if (ROOT / name).is_dir() else shutil.copy)(ROOT / name, tmp_path / name)
    shutil.rmtree(tmp_path / "quadrille" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; assert len(e.queries()) > 60 and set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


def test_nothing_else_imports_the_optional_part():
    for path in (ROOT / "quadrille").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "quadrille.llm" not in path.read_text()
