"""The entry module, with the corpus operators and in a copy without them."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from tessitura.queries import ORACLE_SQL, QUERIES

ROOT = Path(__file__).resolve().parent.parent
SAYS = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), sorted(set(e.queries()) & {'pipeline', 'op1_url_filter'}))"


def said(root):
    return subprocess.run([sys.executable, "-c", SAYS], cwd=root, env={"PATH": "/usr/bin:/bin"}, capture_output=True, text=True, timeout=120, check=True).stdout.strip()


@pytest.mark.parametrize("gone", [["tessitura/llm"], ["tessitura/llm", "corpus_pipeline.py"]])
def test_the_rest_survives_without_the_corpus_operators(tmp_path, gone):
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path)
    shutil.copytree(ROOT / "tessitura", tmp_path / "tessitura", ignore=shutil.ignore_patterns("__pycache__"))
    for name in gone:
        if (tmp_path / name).is_dir():
            shutil.rmtree(tmp_path / name)
        else:
            (tmp_path / name).unlink(missing_ok=True)
    assert said(tmp_path) == f"{len(QUERIES)} {len(ORACLE_SQL)} []"
