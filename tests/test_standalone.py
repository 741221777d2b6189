"""The library stands without the training-data subpackage and its pipeline."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry_without_llm(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", ".pytest_cache", "*.json", "*.md"))
    said = "import __spark_entry__ as e; q = e.queries(); print(len(q), any(n.startswith('op') and n[2].isdigit() for n in q), 'pipeline' in q, set(e.oracle_sql()) <= set(q))"
    for drop in (False, True):
        if not drop:  # the pipeline alone left behind must not break anything either
            (copy / "corpus_pipeline.py").write_text("from fellside.llm import common\n")
        else:
            (copy / "corpus_pipeline.py").unlink()
        env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
        out = subprocess.run([sys.executable, "-c", said], cwd=copy, env=env, capture_output=True, text=True, timeout=120, check=True).stdout.split()
        assert int(out[0]) > 100 and out[1:] == ["False", "False", "True"]
