"""Executors need no copy of the repository."""

from __future__ import annotations

import os
import subprocess
import sys

from tests.llm.conftest import SF

SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql.functions import udf
from refload.session import build_session
spark = build_session("local[2]")

@udf("boolean")
def importable(_):
    import importlib.util
    return importlib.util.find_spec("refload") is not None

assert not spark.range(1).select(importable("id")).first()[0]
from refload.llm.queries import QUERIES
for name in sys.argv[3:]:
    print(name, len(QUERIES[name](spark, sys.argv[2]).collect()))
"""
NAMES = [
    "op1_simhash", "op2_mincut_text", "op3_hilbert_shards", "op4_delta_rollup", "op5_ngram_perplexity", "op6_factorization_machine",
    "op7_best_fit_packing", "op10_multi_index", "op11_source_divergence", "op12_hard_negatives",
]


def test_workers_without_the_package(tmp_path):
    script = tmp_path / "run.py"
    script.write_text(SCRIPT)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    command = [sys.executable, os.fspath(script), repo, SF.replace("0.01", "0.001"), *NAMES]
    done = subprocess.run(command, cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-3000:]
    assert [line.split()[0] for line in done.stdout.splitlines() if line.startswith("op")] == NAMES
