import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_without_the_training_text_package(tmp_path):
    """A copy without ``papyra/llm`` still imports; its queries are those of the library."""
    shutil.copytree(ROOT / "papyra", tmp_path / "papyra", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path / name)
    say = "import __spark_entry__ as e; from papyra.plans import catalogue as c; assert e.queries() == c.QUERIES and e.oracle_sql() == c.ORACLE_SQL; print(len(e.queries()))"
    got = subprocess.run([sys.executable, "-c", say], cwd=tmp_path, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"}, capture_output=True, text=True)
    assert got.returncode == 0 and int(got.stdout) > 100, got.stderr
