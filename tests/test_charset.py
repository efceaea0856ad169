"""Charset detection, scanning with rejects, and logs of other services."""
import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from guardspark.sources import charset as CS
from guardspark.sources import corpus as C
from guardspark.sources import events as E

from .conftest import SF_MID


def _tmp():
    return tempfile.mkdtemp(prefix="guardspark-test-", dir="/tmp")


@pytest.fixture(scope="module")
def model(spark):
    return CS.fit(spark.read.parquet(f"{SF_MID}/documents.parquet").where("doc_id % 4 = 0"))


def test_detection_rate_by_charset(spark, model):
    """Every charset of the candidates, on texts that the model never saw."""
    texts = [r["text"] for r in spark.read.parquet(f"{SF_MID}/documents.parquet").where("doc_id % 4 <> 0").collect()]
    beyond = [t for t in texts if not t.isascii()]
    for name in CS.CANDIDATES:
        asked = beyond if name in ("cp1252", "cp850", "mac_roman") else texts
        right = sum(model.detect(t.encode(name))[0] == name for t in asked if name != "utf-8" or not t.isascii())
        assert right >= 0.99 * len([t for t in asked if name != "utf-8" or not t.isascii()]), name


def test_likelihoods_are_a_distribution(model):
    assert np.allclose(np.exp(model.log_p).sum(axis=1), 1, atol=1e-2)


def test_decoding_of_marks_zero_bytes_and_odd_contents(spark, model):
    cases = {"utf8": "naïve café".encode(), "mark": b"\xef\xbb\xbfabc", "wide": "żółw".encode("utf-16"), "none": None, "empty": b"",
             "le": "The rivers and the stones".encode("utf-16-le"), "be": "The rivers and the stones".encode("utf-16-be"),
             "odd": "The rivers".encode("utf-16-le") + b"x", "bytes": bytes(range(128, 256)) * 40, "one": b"\xe9"}
    df = spark.createDataFrame(list(cases.items()), "name string, content binary")
    got = {r["name"]: r for r in CS.decode_detected(df, model).collect()}
    assert got["utf8"]["text"] == "naïve café" and got["utf8"]["charset"] == "utf-8" and got["utf8"]["confidence"] == 1
    assert got["mark"]["text"] == "abc" and got["wide"]["text"] == "żółw" and got["empty"]["text"] == ""
    assert got["none"]["text"] is None and got["none"]["charset"] is None
    assert got["le"]["charset"] == "utf-16-le" and got["be"]["charset"] == "utf-16-be"
    assert got["le"]["text"] == got["be"]["text"] == "The rivers and the stones"
    for name in ("odd", "bytes", "one"):
        assert got[name]["text"] and 0 <= got[name]["confidence"] <= 1


def test_model_of_no_texts_still_decodes(spark):
    empty = CS.fit(spark.createDataFrame([], "text string"))
    assert empty.detect(b"\xe9t\xe9")[0] in CS.CANDIDATES


def test_scan_gives_every_file_once_accepted_or_with_a_reason(spark):
    d = _tmp()
    os.mkdir(f"{d}/sub")
    for name, data in {"a.TXT": b"a", "sub/b.md": b"b" * 10, "c.pdf": b"%PDF", "README": b"x", "big.markdown": b"x" * 101, "e.txt": b""}.items():
        with open(f"{d}/{name}", "wb") as f:
            f.write(data)
    ok, bad = C.scan_with_rejects(spark, d, max_bytes=100)
    assert {r["source_file"]: bytes(r["content"]) for r in ok.collect()} == {"a.TXT": b"a", "b.md": b"b" * 10}
    assert {r["source_file"]: r["reason"] for r in bad.collect()} == {
        "c.pdf": 'unsupported type ".pdf"', "README": 'unsupported type ""', "big.markdown": "larger than 100 bytes"}
    # Rejected files are listed, not read: no content column in the scan.
    plan = bad._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan


def test_scan_lists_and_reads_in_tasks(spark):
    """No file index on the driver; the same files and paths as Spark's source
    gives, over several levels and with names that it leaves out."""
    d = _tmp()
    for name in ("a.txt", "x=1/b c.md", "x=1/y/d.txt", "x=1/y/e.bin", "_z=2/f.txt", "_hidden/g.txt", ".h.txt", "_part-1.txt", "x=1/i.txt._COPYING_", "x=1/empty.txt"):
        os.makedirs(os.path.dirname(f"{d}/{name}"), exist_ok=True)
        with open(f"{d}/{name}", "w") as f:
            f.write("" if "empty" in name else name)
    want = {r.path: (r.length, bytes(r.content)) for r in spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(d).collect()}
    assert len(want) == 5
    for path in (d, f"file://{d}/"):
        ok, bad = C.scan_with_rejects(spark, path, max_bytes=100)
        for df in (ok, bad):
            assert "binaryFile" not in df._jdf.queryExecution().executedPlan().toString()
        assert {r["path"]: (r["length"], bytes(r["content"])) for r in ok.collect()} == {k: v for k, v in want.items() if not k.endswith(".bin")}
        assert [r["path"] for r in bad.collect()] == [k for k in want if k.endswith(".bin")]
    one, none = C.scan_with_rejects(spark, f"{d}/x=1/y/*.txt")       # a pattern goes through Spark's source
    assert [r["source_file"] for r in one.collect()] == ["d.txt"] and none.count() == 0
    empty, none = C.scan_with_rejects(spark, _tmp())
    assert empty.count() == none.count() == 0


def test_unknown_detail_fields_survive(spark):
    d = _tmp()
    lines = ['{"event_type": "A", "details": {"x": {"y": [1, {"z": "deep"}]}}, "threat_level": 0.5, "timestamp": "2024-01-01T00:00:00"}',
             '{"event_type": "B", "details": "just text", "timestamp": "2024-01-02T00:00:00"}', '{"event_type": "C"}', "{broken"]
    spark.createDataFrame([(x,) for x in lines], "value string").write.text(f"{d}/in")
    ev = E.load_foreign_events(spark, f"{d}/in").cache()
    assert [r["_corrupt_record"] for r in ev.where("_corrupt_record is not null").collect()] == ["{broken"]
    E.append_foreign_events(ev.where("_corrupt_record is null").drop("_corrupt_record"), f"{d}/log")
    E.append_foreign_events(ev.where("event_type = 'A'").drop("_corrupt_record"), f"{d}/log")
    t = E.load_foreign_log(spark, f"{d}/log")
    got = t.select("event_type", F.try_variant_get("details", "$.x.y[1].z", "string").alias("z"), F.col("details").isNull().alias("none"))
    assert sorted((r["event_type"], r["z"], r["none"]) for r in got.collect()) == [("A", "deep", False), ("A", "deep", False), ("B", None, True), ("C", None, True)]
