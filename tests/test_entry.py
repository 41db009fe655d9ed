"""The driver started in another folder, without the repository on anybody's path."""

from __future__ import annotations

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = """
import sys
sys.path.append(sys.argv[1])
import __spark_entry__ as driver
from winnow.session import local_session
spark = local_session(2, 2)
for name in sys.argv[3:]:
    print(name, driver.queries()[name](spark, sys.argv[2]).count())
"""


def run_elsewhere(folder, sf_dir, *names):
    script = folder / "run.py"
    script.write_text(CODE)
    environment = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, str(script), REPO, sf_dir, *names], cwd=folder, env=environment, capture_output=True, text=True, timeout=300
    )
    assert done.returncode == 0, done.stderr[-2000:]
    return dict(line.split() for line in done.stdout.splitlines() if line.split()[0] in names)


def test_queries_with_python_workers_run_from_any_folder(tmp_path, sf_dir):
    assert int(run_elsewhere(tmp_path, sf_dir, "cosine_topk")["cosine_topk"]) > 0


def test_entry_without_the_corpus_part(tmp_path):
    """Any module that only the corpus part needs may be missing."""
    (tmp_path / "public_tokenizers.py").write_text("raise ModuleNotFoundError('none here', name='public_tokenizers')")
    code = f"import sys; sys.path[:0] = [{str(tmp_path)!r}, {REPO!r}]; import __spark_entry__ as d; q = d.queries(); assert len(q) > 80 and 'pipeline' not in q"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
