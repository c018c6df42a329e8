"""The entry lists the library's queries whatever the corpus operators need."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).parent.parent
LISTED = """
import sys
hidden = {hidden!r}
class Hide:
    def find_spec(self, name, path=None, target=None):
        if name.split(".")[0] in hidden or name in hidden:
            raise ModuleNotFoundError(f"No module named {{name!r}}", name=name)
sys.meta_path.insert(0, Hide())
import __spark_entry__ as entry
names = entry.queries()
print(len(names), sum(n.startswith("op") and n[2].isdigit() or n == "pipeline" for n in names), set(entry.oracle_sql()) <= set(names))
"""


def listed(*hidden):
    out = subprocess.run([sys.executable, "-c", LISTED.format(hidden=set(hidden))], cwd=ROOT, capture_output=True, text=True, check=True)
    return out.stdout.split()[-3:]


def test_the_library_is_listed_without_the_corpus_operators():
    alone = listed("corpus_pipeline", "prospectra.llm")
    assert int(alone[0]) >= 145 and alone[1:] == ["0", "True"]
    for missing in ("tiktoken", "zstandard", "xxhash", "public_tokenizers"):
        assert listed(missing) in (alone, listed())
