"""The entry module on copies of the repository that lack parts of it."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parents[1]
SCRIPT = """
import sys
for name in {blocked!r}:
    sys.modules[name] = None
import __spark_entry__ as e
q = e.queries()
assert len(q) >= 100 and set(e.oracle_sql()) <= set(q)
print(sum(n.startswith("op") and n[2].isdigit() for n in q), "pipeline" in q)
"""


def registered(folder, blocked=()):
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(blocked=list(blocked))], cwd=folder, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    return done.stdout.split()


@pytest.fixture
def copy(tmp_path):
    for name in ("brightcask", "__spark_entry__.py", "corpus_pipeline.py"):
        if (REPO / name).is_dir():
            shutil.copytree(REPO / name, tmp_path / name, ignore=shutil.ignore_patterns("__pycache__"))
        elif (REPO / name).exists():
            shutil.copy(REPO / name, tmp_path / name)
    return tmp_path


def test_without_the_training_data_operators(copy):
    shutil.rmtree(copy / "brightcask" / "llm", ignore_errors=True)
    assert registered(copy) == ["0", "False"]


def test_without_the_operators_and_the_pipeline(copy):
    shutil.rmtree(copy / "brightcask" / "llm", ignore_errors=True)
    (copy / "corpus_pipeline.py").unlink(missing_ok=True)
    assert registered(copy) == ["0", "False"]


@pytest.mark.parametrize("library", ["xxhash", "tiktoken", "public_tokenizers"])
def test_without_an_optional_library(copy, library):
    assert registered(copy, [library]) == ["0", "False"]
