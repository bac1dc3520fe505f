"""The entry module without the corpus subpackage or what it needs."""

import subprocess
import sys
from pathlib import Path

import pytest

HIDE = """
import sys
class Hidden:
    def find_spec(self, name, path=None, target=None):
        if name == {name!r} or name.startswith({name!r} + "."):
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Hidden())
import __spark_entry__ as entry
names = set(entry.queries())
print(len(names), any(n.startswith("op") for n in names), "pipeline" in names, set(entry.oracle_sql()) <= names)
"""


@pytest.mark.parametrize("name", ["forumlake.llm", "public_tokenizers", "corpus_pipeline"])
def test_entry_without(name):
    root = Path(__file__).resolve().parent.parent
    done = subprocess.run([sys.executable, "-c", HIDE.format(name=name)], cwd=root, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    count, corpus, pipeline, checks = done.stdout.split()
    assert int(count) >= 84 and pipeline == "False" and checks == "True"
    assert corpus == "False" or name == "corpus_pipeline"
