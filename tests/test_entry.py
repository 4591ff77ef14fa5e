"""The registry: it loads, with and without the subpackage of training-data operators, and the flagship runs."""

import importlib.util
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_flagship_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0


def test_names_agree():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.HAS_LLM == (importlib.util.find_spec("corpuscle.llm") is not None and (ROOT / "corpus_pipeline.py").exists())
    if entry.HAS_LLM:
        assert {int(n[2:].split("_")[0]) for n in entry.queries() if n.startswith("op")} == set(range(1, 14))
        assert "pipeline" in entry.queries()


def test_loads_without_the_subpackage(tmp_path):
    for name in ("__spark_entry__.py",):
        (tmp_path / name).write_text((ROOT / name).read_text())
    for file in (ROOT / "corpuscle").rglob("*.py"):
        part = file.relative_to(ROOT)
        if "llm" not in part.parts:
            (tmp_path / part).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / part).write_text(file.read_text())
    code = "import __spark_entry__ as e; assert not e.HAS_LLM; print(len(e.queries()), len(e.oracle_sql()))"
    found = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
    assert found.returncode == 0, found.stderr
    assert int(found.stdout.split()[0]) > 50
