"""The rest of the library works without the training-text package."""

import re
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent

HIDDEN = """
import sys
sys.path.insert(0, {root!r})

class Hidden:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.split(".")[:2] == ["pagemill", "llm"]:
            raise ModuleNotFoundError("hidden", name=name)

sys.meta_path.insert(0, Hidden())
import __spark_entry__ as entry
names = set(entry.queries())
assert len(names) > 150 and "src9_sitemap_frontier" in names, len(names)
assert not [n for n in names if n == "pipeline" or n.startswith("op")]
"""


def test_import_with_both_folders_hidden():
    subprocess.run([sys.executable, "-c", HIDDEN.format(root=str(ROOT))], check=True, timeout=120)


def test_nothing_outside_names_the_package():
    for folder in ("functions", "operators", "plans", "sinks", "sources"):
        for file in (ROOT / "pagemill" / folder).glob("*.py"):
            assert not re.search(r"import .*\bllm\b|\bllm\b.* import", file.read_text()), file
