"""The driver imports the entry before it has a session."""

import os
import subprocess
import sys


def test_entry_imports_without_a_session():
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))), capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
    assert int(out.stdout) > 150
