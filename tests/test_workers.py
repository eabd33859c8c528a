"""Python helpers must reach workers that cannot import the package."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent

SCRIPT = f"""
import importlib.util
spec = importlib.util.spec_from_file_location("__spark_entry__", r"{ROOT}/__spark_entry__.py")
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)
from seamline.session import local_session
spark = local_session("4", "elsewhere")
for name in ("n18_probability_of_improvement", "m09_tree_attribution", "r05_keyed_change_detection", "u03_pluggable_source", "u04_table_valued_chunker"):
    assert entry.queries()[name](spark, "/root/testdata/sf0.001").count() > 0, name
print("workers ok")
"""


def test_queries_run_from_another_folder(tmp_path):
    done = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert "workers ok" in done.stdout, done.stderr[-2000:]
