"""Sources and sinks in temporary folders."""

import json

import pytest

from glyphlake.sources import records


def test_images(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.PNG").write_bytes(bytes.fromhex("89504e47") + b"..")
    (tmp_path / "bad.jpg").write_bytes(b"nothing")
    (tmp_path / "empty.jpeg").write_bytes(b"")
    (tmp_path / "note.txt").write_text("x")
    good, bad = records.images(spark, str(tmp_path))
    assert [r["path"].rsplit("/", 1)[1] for r in good.collect()] == ["x.PNG"]
    codes = {r["path"].rsplit("/", 1)[1]: r["error_code"] for r in bad.collect()}
    assert codes == {"bad.jpg": "UNREADABLE_IMAGE", "note.txt": "UNSUPPORTED_FILE_TYPE"}


def test_keywords(spark, tmp_path):
    path = tmp_path / "k.json"
    path.write_text(json.dumps({"keywords": ["a", "b"]}, indent=1))
    assert [tuple(r) for r in records.keywords(spark, str(path)).collect()] == [(0, "a"), (1, "b")]
    assert records.keywords(spark, str(tmp_path / "none.json")).count() == 0


def test_audit_store(spark, tmp_path):
    folder = str(tmp_path / "runs")
    records.save_runs(spark.createDataFrame([("r1", 1.5), ("r2", None)], "invoice_id string, total double"), folder)
    assert tuple(records.load_run(spark, folder, "r1", "invoice_id string, total double").first()) == ("r1", 1.5)
    records.save_runs(spark.createDataFrame([("r1", 2.5)], "invoice_id string, total double"), folder)
    assert [tuple(r) for r in records.load_run(spark, folder, "r1", "invoice_id string, total double").collect()] == [("r1", 2.5)]
    with pytest.raises(KeyError):
        records.load_run(spark, folder, "r3", "invoice_id string, total double")


def test_synthetic_pages(spark):
    once, again = (sorted(map(tuple, records.synthetic_pages(spark, 5).collect())) for _ in range(2))
    assert once == again and len({r[0] for r in once}) == 5
