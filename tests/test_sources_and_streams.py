import json
from datetime import datetime, timedelta

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql.types import LongType, StringType, StructField, StructType

from quire.sources import files
from quire.streaming.logs import idempotent_stream, session_counts, upsert_batches

READ_ERRORS = (PySparkException, Py4JJavaError)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_json(spark, tmp_path):
    (tmp_path / "o").mkdir()
    (tmp_path / "o" / "a.json").write_text(' {"k": 1,\n "s": "é"}')
    assert rows(files.read_json_object(spark, str(tmp_path / "o"), "k long, s string")) == [(1, "é")]
    (tmp_path / "o" / "b.json").write_text("[1]")
    with pytest.raises(ValueError):
        files.read_json_object(spark, str(tmp_path / "o"), "k long, s string")
    df = spark.createDataFrame([(1, "x\ny"), (2, None)], "k long, s string")
    files.write_json_lines(df, str(tmp_path / "l"))
    assert rows(files.read_json_lines(spark, str(tmp_path / "l"), "k long, s string")) == rows(df)
    (tmp_path / "bad.json").write_text('{"k": 1}\n{"k": ')
    with pytest.raises(READ_ERRORS):
        files.read_json_lines(spark, str(tmp_path / "bad.json"), "k long").collect()


def test_csv(spark, tmp_path):
    df = spark.createDataFrame([("1", 'a "q", b'), ("02", "two\nlines")], "k string, s string")
    files.write_csv(df.coalesce(1), str(tmp_path / "c"))
    assert rows(files.read_text_csv(spark, str(tmp_path / "c"), ["k", "s"])) == rows(df)
    with pytest.raises(READ_ERRORS):
        files.read_text_csv(spark, str(tmp_path / "c"), ["k", "other"]).collect()
    with pytest.raises(READ_ERRORS):
        files.write_csv(df, str(tmp_path / "c"))


def test_folders(spark, tmp_path):
    for name, text in (("p2.txt", "two"), ("p10.txt", "ten"), ("sub/p1.txt", "one")):
        (tmp_path / "f" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "f" / name).write_text(text)
    found = files.inventory(spark, str(tmp_path / "f"), "*.txt")
    assert [r["path"].split("/f/")[1] for r in found.orderBy("natural_order_key").collect()] == ["p2.txt", "p10.txt", "sub/p1.txt"]
    before = files.tree_hash(found).first()
    assert before == files.tree_hash(found.repartition(3)).first()
    recorded = found.limit(2).unionByName(spark.createDataFrame([("/x", "h")], "path string, sha256 string"), allowMissingColumns=True)
    (tmp_path / "f" / "p2.txt").write_text("changed")
    assert files.tree_hash(files.inventory(spark, str(tmp_path / "f"), "*.txt")).first() != before
    held = spark.createDataFrame([tuple(r) for r in recorded.where("path = '/x'").select("path", "sha256").collect()] + [(str(tmp_path / "f/p10.txt"), "other")], "path string, sha256 string")
    states = dict(rows(files.checked_artifacts(held, files.inventory(spark, str(tmp_path / "f"), "p*.txt"))))
    assert states["/x"] == "missing" and sorted(states.values()) == ["hash_mismatch", "missing", "unrecorded", "unrecorded"]
    written = files.write_once(spark.range(5).coalesce(1), str(tmp_path / "out"))
    assert written.count() == 1
    with pytest.raises(READ_ERRORS):
        files.write_once(spark.range(5), str(tmp_path / "out"))


def test_form_and_contract(spark):
    text = "intro: no list\n- early: 1\n## Case A\n- [x] visible: yes\n- note： 二: 三\ntext\n## Case B\n* empty:\n"
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, form string")
    assert rows(files.parse_form(df, "id", "form")) == sorted([(1, None, "early", "1"), (1, "Case A", "visible", "yes"), (1, "Case A", "note", "二: 三"), (1, "Case B", "empty", "")], key=repr)
    assert files.missing_columns(df, StructType([StructField("id", LongType()), StructField("form", StringType()), StructField("x", StringType())])) == ["id", "x"]


def test_streams(spark, tmp_path):
    start = datetime(2025, 1, 1)
    events = [("a", "k1", 0), ("a", "k1", 1), ("a", "k2", 20), ("b", "k3", 5), ("a", "k4", 200), ("b", "k5", 500)]
    lines = [json.dumps({"user": u, "key": k, "ts": (start + timedelta(minutes=m)).isoformat()}) for u, k, m in events]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text("\n".join(lines))
    stream = spark.readStream.schema("user string, key string, ts timestamp").json(str(tmp_path / "in"))
    q = idempotent_stream(stream, "key", "ts", "1 hour").writeStream.format("memory").queryName("replayed").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["key"] for r in spark.table("replayed").collect()) == ["k1", "k2", "k3", "k4", "k5"]
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for _ in range(2):
        q = session_counts(stream, "user", "ts", "30 minutes", "0 seconds").writeStream.outputMode("append").option("checkpointLocation", state).foreachBatch(lambda b, i: upsert_batches(b, i, out)).start()
        q.processAllAvailable()
        q.stop()
    assert sorted((r["user"], r["n_events"]) for r in spark.read.parquet(out).collect())[:3] == [("a", 1), ("a", 3), ("b", 1)]


def test_atomic_output(spark, tmp_path):
    from quire.sources.files import write_atomic

    target = str(tmp_path / "out")
    write_atomic(spark.range(3), target)
    assert spark.read.parquet(target).count() == 3 and not (tmp_path / "_out.part").exists()
    with pytest.raises(FileExistsError):
        write_atomic(spark.range(5), target)
    assert spark.read.parquet(target).count() == 3


def test_image_sizes(spark, tmp_path):
    from quire.sources.files import image_sizes

    png = b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + (300).to_bytes(4, "big") + (70000).to_bytes(4, "big") + b"rest"
    gif = b"GIF89a" + (513).to_bytes(2, "little") + (7).to_bytes(2, "little")
    jpeg = b"\xff\xd8\xff\xe0\0\x10" + b"x" * 14 + b"\xff\xdb\0\x05abc" + b"\xff\xc2\0\x11\x08" + (480).to_bytes(2, "big") + (640).to_bytes(2, "big") + b"\x03"
    for name, data in (("a.png", png), ("b.gif", gif), ("c.jpg", jpeg), ("d.jpg", jpeg[:24]), ("e.txt", b"plain"), ("f", b"x")):
        (tmp_path / name).write_bytes(data)
    got = {r["path"].rsplit("/", 1)[1]: tuple(r)[1:] for r in image_sizes(spark, str(tmp_path)).collect()}
    assert got == {"a.png": ("png", 300, 70000), "b.gif": ("gif", 513, 7), "c.jpg": ("jpeg", 640, 480), "d.jpg": ("jpeg", None, None), "e.txt": (None, None, None), "f": (None, None, None)}


def test_connect_and_foreign_keys(spark, tmp_path):
    from quire.sources.tables import connect, foreign_key_violations

    spark.createDataFrame([(1, "a"), (2, "z"), (3, None), (4, "z")], "i int, ref string").write.parquet(str(tmp_path / "child.parquet"))
    spark.createDataFrame([("a",), ("b",)], "id string").write.parquet(str(tmp_path / "parent.parquet"))
    held = connect(spark, str(tmp_path), ["child", "parent"])
    assert [tuple(r) for r in foreign_key_violations(held["child"], "ref", held["parent"], "id").collect()] == [("z", 2)]
    with pytest.raises(FileNotFoundError, match="other"):
        connect(spark, str(tmp_path), ["child", "other"])


def test_sample_pages(spark):
    import hashlib

    from quire.sources.samples import sample_pages

    held = sample_pages(spark).collect()
    assert len(held) == 4 and [len(r["boxes"]) for r in held] == [1, 1, 2, 0]
    assert all(len(r["pixels"]) == r["height"] * r["width"] * 3 and hashlib.sha256(bytes(r["pixels"])).hexdigest() == r["sha256"] for r in held)
