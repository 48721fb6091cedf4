import os
import re
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_nothing_else_imports_the_training_data_operators():
    files = [p for p in (ROOT / "seaweft").rglob("*.py") if "llm" not in p.parts]
    assert files and not [p for p in files if re.search(r"seaweft\.llm|corpus_pipeline", p.read_text())]


def test_entry_works_without_them(tmp_path):
    shutil.copytree(ROOT / "seaweft", tmp_path / "seaweft", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'm0_port_edges' in q and 'pipeline' not in q and not [k for k in q if k.startswith('op1')]; assert set(e.oracle_sql()) <= set(q); print(len(q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert out.returncode == 0 and int(out.stdout) > 100, out.stderr


def test_no_local_checkpoints_and_no_machine_local_writes():
    for p in [*(ROOT / "seaweft").rglob("*.py"), ROOT / "corpus_pipeline.py"]:
        if p.exists():
            text = p.read_text()
            assert "localCheckpoint" not in text and "/tmp" not in text, p
            if p.name != "checkpoints.py":  # which makes one for local sessions only, see test_jobs.py
                assert "tempfile" not in text and "mkdtemp" not in text, p
