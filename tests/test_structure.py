"""The library stands without the training-data operators."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent

WITHOUT = """
import importlib, pkgutil, sys
sys.modules["plumbline.llm"] = None
sys.modules["corpus_pipeline"] = None
import plumbline
names = [m.name for m in pkgutil.walk_packages(plumbline.__path__, "plumbline.", onerror=lambda n: None)
         if not m.name.startswith("plumbline.llm")]
for name in names:
    importlib.import_module(name)
import workload.queries
import __spark_entry__ as entry
assert len(names) > 20 and len(entry.queries()) > 240
assert not any(k.startswith("op1_") or k == "pipeline" for k in entry.queries())
"""


def test_imports_without_the_training_data_operators():
    done = subprocess.run([sys.executable, "-c", WITHOUT], cwd=ROOT, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr[-2000:]


def test_nothing_else_names_them():
    for folder in ("plumbline", "workload"):
        for path in (ROOT / folder).rglob("*.py"):
            if "llm" not in path.parts:
                assert "llm" not in path.read_text(), path
