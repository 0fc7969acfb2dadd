"""The driver's entry point with the training-data parts present, absent and without their libraries."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
COUNT = "import __spark_entry__ as e; q = e.queries(); print(len(q), any(n.startswith('op') for n in q), 'pipeline' in q)"
HIDE = """
import sys
class Hidden:
    def find_spec(self, name, path=None, target=None):
        if any(name == h or name.startswith(h + '.') for h in {names!r}):
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Hidden())
"""


def loaded(hidden):
    code = HIDE.format(names=hidden) + COUNT
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True)
    n, operators, pipeline = out.stdout.split()[-3:]
    return int(n), operators == "True", pipeline == "True"


@pytest.mark.parametrize("hidden", [
    ["wattloom.llm"], ["corpus_pipeline"], ["wattloom.llm", "corpus_pipeline"], ["public_tokenizers"]])
def test_the_household_queries_load_without_the_rest(hidden):
    n, operators, pipeline = loaded(hidden)
    assert n >= 91 and not pipeline
    if hidden != ["corpus_pipeline"]:
        assert not operators and n == loaded(["wattloom.llm", "corpus_pipeline"])[0]
