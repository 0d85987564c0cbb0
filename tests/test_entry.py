from __future__ import annotations

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.001"


def test_names_match():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 50


def test_library_stands_without_the_corpus_operators(tmp_path):
    for name in ("lodestrata", "__spark_entry__.py"):
        os.symlink(f"{ROOT}/{name}", tmp_path / name) if name.endswith(".py") else _copy(f"{ROOT}/{name}", tmp_path / name)
    code = "import sys; sys.path.insert(0, sys.argv[1]); import importlib.util as u; s = u.spec_from_file_location('e', sys.argv[1] + '/__spark_entry__.py'); m = u.module_from_spec(s); sys.path_importer_cache.clear(); s.loader.exec_module(m); print(len(m.queries()))"
    entry = (tmp_path / "__spark_entry__.py").read_text()
    os.remove(tmp_path / "__spark_entry__.py")
    (tmp_path / "__spark_entry__.py").write_text(entry)
    done = subprocess.run([sys.executable, "-c", code, str(tmp_path)], capture_output=True, text=True, cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert done.returncode == 0, done.stderr
    assert int(done.stdout) > 50


def _copy(source, to):
    import shutil

    shutil.copytree(source, to, ignore=shutil.ignore_patterns("llm", "__pycache__"))


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_flagship(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1
