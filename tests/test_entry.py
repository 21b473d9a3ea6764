"""The core queries do not depend on the text package."""

import os
import shutil
import subprocess
import sys

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
COUNT = "import __spark_entry__ as e, linkledger.plans as p; assert set(p.load_catalog()[0]) <= set(e.queries()) and set(p.load_catalog()[1]) <= set(e.oracle_sql()); print(len(e.queries()) - len(p.load_catalog()[0]))"


def text_queries(folder, before=""):
    out = subprocess.run([sys.executable, "-B", "-c", before + COUNT], cwd=folder, env={**os.environ, "PYTHONPATH": str(folder)}, capture_output=True, text=True, check=True)
    return int(out.stdout.split()[-1])


@pytest.mark.parametrize("left", ["nothing", "empty folder", "broken library"])
def test_core_queries_stay_without_the_text_package(tmp_path, left):
    folder = tmp_path / "repo"
    shutil.copytree(REPO, folder, ignore=shutil.ignore_patterns(".git", "__pycache__", "tests"))
    if left == "broken library":
        assert text_queries(folder, "import sys; sys.modules['ahocorasick'] = sys.modules['tokenizers'] = None; sys.modules['numpy'] = None\n") == 0
        return
    shutil.rmtree(folder / "linkledger" / "llm", ignore_errors=True)
    (folder / "corpus_pipeline.py").unlink(missing_ok=True)
    if left == "empty folder":
        (folder / "linkledger" / "llm" / "__pycache__").mkdir(parents=True)
    assert text_queries(folder) == 0
