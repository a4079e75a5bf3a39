"""The entry module with and without the corpus subpackage, and where stages are written."""

import json
import pathlib
import shutil
import subprocess
import sys

import pytest
from ravelin.plans import staging

ROOT = pathlib.Path(__file__).resolve().parents[1]
ASK = "import json, __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(json.dumps([sorted(q), sorted(o), callable(e.entry)]))"


def names(folder):
    out = subprocess.run([sys.executable, "-c", ASK], cwd=folder, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    return json.loads(out.stdout.splitlines()[-1])


@pytest.mark.parametrize("gone", [["ravelin/llm", "tests/llm"], ["ravelin/llm", "tests/llm", "corpus_pipeline.py"], []])
def test_the_rest_stands_without_the_corpus_operators(tmp_path, gone):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", *[pathlib.Path(g).name for g in gone]))
    queries, oracle, entry = names(copy)
    assert entry and set(oracle) <= set(queries) and "pair_scores" in queries
    assert any(q.startswith("op1_") for q in queries) == (not gone and (copy / "ravelin/llm").exists())
    assert ("pipeline" in queries) == (copy / "ravelin/llm").exists()


@pytest.mark.parametrize("lacking", ["tokenizers", "xxhash"])
def test_the_rest_stands_where_a_library_is_missing(tmp_path, lacking):
    """As if a library that only the corpus operators use were not installed."""
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__"))
    ask = f"import sys; sys.modules[{lacking!r}] = None; " + ASK
    out = subprocess.run([sys.executable, "-c", ask], cwd=copy, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    queries, oracle, entry = json.loads(out.stdout.splitlines()[-1])
    assert entry and "pair_scores" in queries and "audit_full_outer" in oracle
    assert not any(q.startswith("op") and "_" in q and q[2].isdigit() for q in queries) and "pipeline" not in queries
    assert not (copy / "ravelin/llm").exists() or lacking in out.stderr


def test_stages_need_a_shared_folder_on_a_cluster():
    class Conf:
        def get(self, key):
            return None

    class Context:
        master, applicationId = "spark://host:7077", "app"

        def getConf(self):
            return Conf()

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError, match="checkpoint"):
        staging.shared_dir(Session())
