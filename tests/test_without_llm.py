import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_the_rest_stands_alone(tmp_path):
    """Without the training-data folders the entry lists the other queries."""
    shutil.copytree(ROOT / "packwright", tmp_path / "packwright", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') for n in q), q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})


def test_nothing_else_imports_it():
    for path in (ROOT / "packwright").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "packwright.llm" not in path.read_text() and "corpus_pipeline" not in path.read_text(), path
