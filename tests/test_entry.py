import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry_module

REPO = Path(__file__).resolve().parent.parent


def test_names():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
    assert "stability_profile" in entry_module.queries()


def test_flagship(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["pixel_id", "modal_class", "modal_frequency", "second_class", "second_frequency", "entropy_normalized", "decision_category"]
    assert df.count() > 0


def test_the_rest_stands_alone(tmp_path):
    """Without the training-data folders and the pipeline the entry module still imports."""
    (tmp_path / "__spark_entry__.py").symlink_to(REPO / "__spark_entry__.py")
    package = tmp_path / "fenmark"
    package.mkdir()
    for p in (REPO / "fenmark").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (package / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'stability_profile' in q and not any(k.startswith('op') or k == 'pipeline' for k in q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"})


def test_a_missing_library_is_no_missing_subpackage(tmp_path):
    """Only the subpackage's own absence is passed over."""
    (tmp_path / "__spark_entry__.py").symlink_to(REPO / "__spark_entry__.py")
    package = tmp_path / "fenmark"
    package.mkdir()
    for p in (REPO / "fenmark").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (package / p.name).symlink_to(p)
    (package / "llm").mkdir()
    code = "import __spark_entry__"
    env = {"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"}
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env=env)  # an empty folder
    (package / "llm" / "__init__.py").write_text("")
    (package / "llm" / "queries.py").write_text("import a_library_that_is_not_there\n")
    got = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert got.returncode and "a_library_that_is_not_there" in got.stderr
