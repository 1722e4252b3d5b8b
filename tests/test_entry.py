import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(entry.__file__).parent
SAY = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q), any(x.startswith('op') and x[2:3].isdigit() or x == 'pipeline' for x in q))"


def test_queries_have_names_of_their_own():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and all(map(callable, entry.queries().values()))


def test_entry_without_the_training_data_operators(tmp_path):
    """The entry works in a copy without them: with and without the pipeline's file, and with an empty folder left behind."""
    shutil.copytree(ROOT / "antecede", tmp_path / "antecede", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    for prepare in (lambda: None, lambda: shutil.copy(ROOT / "corpus_pipeline.py", tmp_path), lambda: (tmp_path / "antecede/llm").mkdir()):
        prepare()
        said = subprocess.run([sys.executable, "-c", SAY], cwd=tmp_path, capture_output=True, text=True, timeout=120, check=False)
        assert said.returncode == 0, said.stderr
        assert said.stdout.split()[1] == "False" and int(said.stdout.split()[0]) > 50
