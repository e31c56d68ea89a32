import subprocess
import sys

CODE = """
import sys
sys.modules["corpus_pipeline"] = None
import __spark_entry__ as entry
names = entry.queries()
assert "flagship_cumul_strata" in names and "pipeline" not in names
assert set(entry.oracle_sql()) == set(names)
"""


def test_entry_works_without_the_optional_operators():
    subprocess.run([sys.executable, "-c", CODE], check=True, timeout=120)
