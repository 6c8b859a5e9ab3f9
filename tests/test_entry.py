"""The queries are there before any session is."""

import subprocess
import sys
from pathlib import Path


def test_queries_load_without_a_session():
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert e.queries() and not set(e.oracle_sql()) - set(e.queries())"], cwd=Path(__file__).parents[1], capture_output=True, text=True)
    assert done.returncode == 0, done.stderr[-500:]
