"""All operators and the pipeline are registered where nothing is missing; a missing library is said aloud."""

from __future__ import annotations

import subprocess
import sys

WHOLE = """
import re, warnings
warnings.simplefilter("error", RuntimeWarning)
import __spark_entry__ as entry
found = {int(m[1]) for n in entry.queries() if (m := re.match(r"op([0-9]+)_", n))}
assert found == set(range(1, 14)) and "pipeline" in entry.queries(), found
"""
BLOCKED = """
import sys, warnings
sys.modules["ahocorasick"] = None
with warnings.catch_warnings(record=True) as said:
    warnings.simplefilter("always")
    import __spark_entry__ as entry
assert any("ahocorasick" in str(w.message) for w in said), said
assert len(entry.queries()) >= 115
"""


def test_all_are_registered_or_missing_ones_are_named():
    for code in (WHOLE, BLOCKED):
        done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=__file__.rsplit("/", 3)[0])
        assert done.returncode == 0, done.stderr
