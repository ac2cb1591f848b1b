"""The driver's contract and the bench, as they are called from outside."""

import json
import os
import subprocess
import sys

import __spark_entry__
from tests.conftest import ROOT


def test_every_oracle_has_a_query():
    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 100
    assert all(callable(q) for q in queries.values())


def test_queries_without_the_numbered_operators():
    """Where the subpackage, or something that it needs, cannot be imported the others are there."""
    hidden = "import sys; sys.modules['public_tokenizers'] = None; import __spark_entry__ as e; n = e.queries(); e.oracle_sql(); print(len(n), 'pipeline' in n, any(q.startswith('op1_') for q in n))"
    out = subprocess.run([sys.executable, "-c", hidden], capture_output=True, text=True, cwd=ROOT, check=True, timeout=120).stdout.split()
    assert int(out[0]) > 100 and out[1:] == ["False", "False"]


def test_bench_prints_one_line_of_json():
    env = os.environ | {"BENCH_SF_DIR": "/root/testdata/sf0.001", "BENCH_CPUS": "2"}
    done = subprocess.run([sys.executable, "bench.py", "length_profile", "options_and_answers"], capture_output=True, text=True, cwd=ROOT, check=True, timeout=300, env=env)
    said = json.loads(done.stdout.strip().splitlines()[-1])
    assert list(said["queries"]) == ["length_profile", "options_and_answers"] and said["value"] > 0
