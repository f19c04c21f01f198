import re
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_nothing_imports_the_llm_package():
    for path in [*ROOT.glob("quire/**/*.py"), *ROOT.glob("tests/*.py"), ROOT / "bench.py"]:
        if "quire/llm" not in path.as_posix() and path != Path(__file__).resolve():
            assert not re.search(r"^\s*(from|import) quire\.llm", path.read_text(), re.M), path


def test_no_local_checkpoints_or_collected_rdds():
    for path in ROOT.glob("quire/**/*.py"):
        source = path.read_text()
        assert "localCheckpoint(" not in source and ".rdd" not in source and "crossJoin" not in source and "toPandas" not in source, path
