"""The engine without the llm subpackage."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def run(folder):
    code = "import __spark_entry__ as e; print(sorted(e.queries()), len(e.oracle_sql()))"
    return subprocess.run([sys.executable, "-c", code], cwd=folder, env={**os.environ, "PYTHONPATH": str(folder)}, capture_output=True, text=True, timeout=120)


def test_entry_without_the_llm_folders(tmp_path):
    shutil.copytree(os.path.join(ROOT, "thornwall"), tmp_path / "thornwall", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    for pipeline in (True, False):
        if pipeline and os.path.exists(os.path.join(ROOT, "corpus_pipeline.py")):
            shutil.copy(os.path.join(ROOT, "corpus_pipeline.py"), tmp_path)
        elif (tmp_path / "corpus_pipeline.py").exists():
            os.remove(tmp_path / "corpus_pipeline.py")
        done = run(tmp_path)
        assert done.returncode == 0, done.stderr
        assert "full_scan" in done.stdout
        assert "op1_" not in done.stdout
        assert "pipeline" not in done.stdout
