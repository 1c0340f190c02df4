"""The entry point without its optional part."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).parent.parent
LOOK = "import __spark_entry__ as e; print(*sorted(e.queries())); assert set(e.oracle_sql()) <= set(e.queries())"


@pytest.mark.parametrize("with_pipeline", [True, False])
def test_the_rest_imports_without_llm(tmp_path, with_pipeline):
    shutil.copytree(ROOT / "pricewright", tmp_path / "pricewright", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ["__spark_entry__.py"] + ["corpus_pipeline.py"] * (with_pipeline and (ROOT / "corpus_pipeline.py").exists()):
        shutil.copy(ROOT / name, tmp_path)
    done = subprocess.run([sys.executable, "-c", LOOK], cwd=tmp_path, env={"PATH": ""}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    names = done.stdout.split()
    assert "price_index" in names and "pipeline" not in names and not [n for n in names if n.startswith("op") and n[2].isdigit()]
