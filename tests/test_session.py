"""Where the package and checkpoints go on a cluster, and what the entry does without the llm subpackage's libraries."""

import subprocess
import sys
from pathlib import Path
from types import SimpleNamespace

import pytest

from quire import session

ROOT = Path(__file__).resolve().parent.parent


def fake(master, conf=None):
    sent = []
    context = SimpleNamespace(master=master, listFiles=[], addPyFile=sent.append, getCheckpointDir=lambda: None, setCheckpointDir=sent.append)
    return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda k, d=None: (conf or {}).get(k, d))), sent


@pytest.mark.parametrize("master,local", [("local", True), ("local[8]", True), ("local[*]", True), ("local-cluster[3,2,1024]", False), ("spark://host:7077", False), ("yarn", False)])
def test_masters(master, local):
    spark, sent = fake(master)
    assert session.is_local(spark) is local
    session.ship_package(spark)
    assert bool(sent) is not local  # the working directory is the repository's: only workers elsewhere need the package
    assert all(x.endswith("/quire.zip") for x in sent)


def test_local_workers_of_another_folder_get_the_package(monkeypatch, tmp_path):
    monkeypatch.chdir(tmp_path)
    monkeypatch.setenv("PYTHONPATH", "")
    spark, sent = fake("local[2]")
    session.ship_package(spark)
    assert len(sent) == 1


def test_a_cluster_needs_a_shared_checkpoint_folder(monkeypatch):
    monkeypatch.setattr(session, "without_estimates", lambda df: df)
    for master, conf, fails in (("spark://host:7077", {}, True), ("spark://host:7077", {"spark.checkpoint.dir": "/shared/x"}, False), ("local[2]", {}, False)):
        spark, sent = fake(master, conf)
        df = SimpleNamespace(sparkSession=spark, checkpoint=lambda eager: "cut")
        if fails:
            with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
                session.cut_lineage(df)
        else:
            assert session.cut_lineage(df) == "cut" and len(sent) == 1 and (not conf or sent == ["/shared/x"])


def test_entry_without_the_llm_libraries():
    code = "import sys; sys.modules['ahocorasick'] = None; sys.modules['tiktoken'] = None; import __spark_entry__ as e; q = e.queries(); assert 'p2_found' in q and len(q) > 100; print('fine')"
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True)
    assert done.stdout.strip() == "fine", done.stderr


def test_rounds_of_joins_stay_quick(spark):
    """A checkpoint's estimated size would be squared in every round."""
    df = spark.range(50).selectExpr("id", "id + 1 AS next")
    for _ in range(25):
        ahead = df.selectExpr("id AS at", "next AS next2")
        df = session.cut_lineage(df.join(ahead, df["next"] == ahead["at"], "left").selectExpr("id", "coalesce(next2, next) AS next"))
    assert df.count() == 50 and len(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 30
