"""The entry registers what can be imported, and says what it leaves out."""

from __future__ import annotations

import subprocess
import sys

BLOCKED = """
import sys, warnings
sys.modules["probitas.llm"] = None  # any import of it fails
with warnings.catch_warnings(record=True) as said:
    warnings.simplefilter("always")
    import __spark_entry__ as entry
assert any("not registered" in str(w.message) for w in said), said
names = set(entry.queries())
assert len(names) >= 115 and "a1_risk_scores" in names and "pipeline" not in names and not any(n.startswith("op") for n in names)
assert set(entry.oracle_sql()) <= names
"""


def test_other_queries_stay_without_the_subpackage():
    done = subprocess.run([sys.executable, "-c", BLOCKED], capture_output=True, text=True, cwd=__file__.rsplit("/", 2)[0])
    assert done.returncode == 0, done.stderr
