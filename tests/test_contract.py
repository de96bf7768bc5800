"""The driver contract does not depend on the training-data folder or on what that needs."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

from loadcast.catalog import all_queries

ROOT = Path(__file__).resolve().parent.parent
BLOCKED = """
import sys
for name in {names!r}:
    sys.modules[name] = None
sys.path.insert(0, {root!r})
import __spark_entry__ as contract
print(len(contract.queries()), len(contract.oracle_sql()))
"""


@pytest.mark.parametrize("names", [["xxhash"], ["tiktoken"], ["tokenizers"], ["public_tokenizers"], ["loadcast.llm"], ["corpus_pipeline"]])
def test_core_queries_need_no_other_package(names):
    code = BLOCKED.format(names=names, root=str(ROOT))
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, env=os.environ | {"PYTHONDONTWRITEBYTECODE": "1"}, check=True)
    n, sql = map(int, done.stdout.split())
    assert n >= len(all_queries()) and sql >= len(all_queries()) - 1
