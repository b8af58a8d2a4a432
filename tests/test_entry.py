import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


def names(folder):
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(*q)"
    return subprocess.run([sys.executable, "-c", code], cwd=folder, capture_output=True, text=True, check=True).stdout.split()


def test_names_need_no_session():
    assert "flagship_accuracy_records" in names(ROOT)


def test_entry_stands_without_the_corpus_part(tmp_path):
    shutil.copytree(ROOT / "tessella", tmp_path / "tessella", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    found = names(tmp_path)
    assert len(found) > 100 and not any(n.startswith("op") for n in found)


def test_a_broken_import_is_an_error(tmp_path):
    """Only what is not there may be left out: the corpus part as a whole, or a library of others."""
    shutil.copytree(ROOT / "tessella", tmp_path / "tessella", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    part = tmp_path / "tessella" / "llm"
    part.mkdir()
    (part / "__init__.py").write_text("")
    (part / "queries.py").write_text("import no_such_library\n")
    assert len(names(tmp_path)) > 100
    for text in ("from tessella.llm import no_such_module\n", "import tessella.llm.no_such_module\n"):
        (part / "queries.py").write_text(text)
        with pytest.raises(subprocess.CalledProcessError):
            names(tmp_path)


def test_flagship(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).collect()
    assert {r.metric for r in rows} == {"rmse", "mae", "r2"} and {r.split for r in rows} == {"train", "val", "test", "full"}
