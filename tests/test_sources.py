"""Sources and sinks: text files, decoding, the chunk table, the event log."""
import os
import tempfile

from pyspark.sql import functions as F

from guardspark.sources import corpus as C
from guardspark.sources import events as E

from .conftest import SF_SMALL


def _tmp():
    return tempfile.mkdtemp(prefix="guardspark-test-", dir="/tmp")


def test_scan_and_decode(spark):
    d = _tmp()
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").orderBy("doc_id").limit(3).collect()
    files = {
        "a.txt": docs[0].text.encode("utf-8"),
        "b.MD": b"\xef\xbb\xbf" + docs[1].text.encode("utf-8"),
        "c.markdown": "\ufeff".encode("utf-16-le") + docs[2].text.encode("utf-16-le"),
        "d.txt": b"caf\xe9 latin-1",
        "e.pdf": b"%PDF-1.4",
        "big.txt": b"x" * 2048,
    }
    for name, data in files.items():
        with open(os.path.join(d, name), "wb") as f:
            f.write(data)
    df = C.scan_text_corpus(spark, d)
    names = sorted(r.source_file for r in df.collect())
    assert names == ["a.txt", "b.MD", "big.txt", "c.markdown", "d.txt"]
    small = C.scan_text_corpus(spark, d, max_bytes=1024)
    assert "big.txt" not in {r.source_file for r in small.collect()}
    got = {r.source_file: r.text for r in C.decode_text(df).collect()}
    assert got["a.txt"] == docs[0].text
    assert got["b.MD"] == docs[1].text
    assert got["c.markdown"] == docs[2].text
    assert got["d.txt"] == b"caf\xe9 latin-1".decode("utf-8", errors="replace")
    rejected = C.rejected_files(spark, d, max_bytes=1024).collect()
    assert ("big.txt", 2048, "larger than 1024 bytes") in [(r.source_file, r.length, r.reason) for r in rejected]
    assert {r.source_file for r in rejected} | {r.source_file for r in small.collect()} == set(names)
    latin = {r.source_file: r.text for r in C.decode_text(df, fallback_charset="ISO-8859-1").collect()}
    assert latin["d.txt"] == "café latin-1"


def test_chunk_table_lifecycle(spark):
    d = _tmp()
    docs = (spark.read.parquet(f"{SF_SMALL}/documents.parquet")
                 .withColumnRenamed("source", "source_file"))
    chunks = C.ingest_corpus(docs)
    C.save_chunks(chunks, f"{d}/t")
    n_all = C.load_chunks(spark, f"{d}/t").count()
    assert n_all == chunks.count() > 0
    removed = C.delete_by_source(spark, f"{d}/t", "src0", f"{d}/t2")
    left = C.load_chunks(spark, f"{d}/t2")
    assert removed + left.count() == n_all and left.where("source_file = 'src0'").count() == 0
    C.append_chunks(chunks.where("source_file = 'src0'"), f"{d}/t2")
    assert C.load_chunks(spark, f"{d}/t2").count() == n_all
    ids = C.load_chunks(spark, f"{d}/t2").select("id").distinct().count()
    assert ids == n_all
    C.clear_chunks(spark, f"{d}/t2", chunks.schema)
    assert C.load_chunks(spark, f"{d}/t2").count() == 0


def test_event_log_round_trip(spark):
    d = _tmp()
    ev = spark.createDataFrame(
        [(None, "INPUT_BLOCKED", "x" * 900, (["roleplay"], [], None, None), 0.9, "blocked", None),
         ("2024-01-01 10:00:00", "OUTPUT_SANITIZED", "y", ([], [], None, None), None, None, "s1")],
        "timestamp string, event_type string, input_text string, details struct<categories:array<string>,"
        "patterns_matched:array<string>,reason:string,chunk_index:bigint>, threat_level double, "
        "action_taken string, session_id string")
    E.append_events(ev, f"{d}/log")
    back = E.load_events(spark, f"{d}/log")
    rows = {r.event_type: r for r in back.collect()}
    assert len(rows["INPUT_BLOCKED"].input_text) == 500 and rows["INPUT_BLOCKED"].timestamp is not None
    assert rows["OUTPUT_SANITIZED"].threat_level == 0.0 and rows["OUTPUT_SANITIZED"].action_taken == ""
    E.export_events(back.drop("event_date"), f"{d}/json")
    again = E.load_events(spark, f"{d}/json", fmt="json")
    rows = again.select("event_type", "_corrupt_record").collect()
    assert len(rows) == 2 and all(r._corrupt_record is None for r in rows)
    E.clear_events(spark, f"{d}/log")
    assert E.load_events(spark, f"{d}/log").count() == 0


def test_event_log_json_array(spark):
    d = _tmp()
    with open(os.path.join(d, "security_events.json"), "w") as f:
        f.write('[{"timestamp": "2024-01-01T10:00:00", "event_type": "INPUT_BLOCKED", "input_text": "x", '
                '"details": {"categories": ["jailbreak"]}, "threat_level": 0.9, "action_taken": "blocked", '
                '"session_id": ""}, {"timestamp": "2024-01-01T11:00:00", "event_type": "OUTPUT_SANITIZED", '
                '"input_text": "y", "details": {"issues": []}, "threat_level": 0.0, "action_taken": "sanitized", '
                '"session_id": ""}]')
    rows = E.load_events(spark, d, fmt="json", json_array=True).select("event_type", "details.categories").collect()
    assert [(r.event_type, r.categories) for r in rows] == [("INPUT_BLOCKED", ["jailbreak"]), ("OUTPUT_SANITIZED", None)]


def test_malformed_bytes_never_fail_the_job(spark):
    rows = [(0, b"\xff\xfe\x00\xd8\x41"), (1, b"\xfe\xff\xd8\x00"), (2, b"caf\xe9"), (3, b""), (4, None), (5, b"\xc3\xa9 ok")]
    df = spark.createDataFrame(rows, "id long, content binary")
    plain = {r.id: r.text for r in C.decode_text(df).collect()}
    ascii_ = {r.id: r.text for r in C.decode_text(df, fallback_charset="US-ASCII").collect()}
    for i in (0, 1):
        assert plain[i] == ascii_[i] == rows[i][1].decode("utf-16", errors="replace")
    assert plain[2] == ascii_[2] == "caf\ufffd"
    assert (plain[3], plain[4], plain[5]) == ("", None, "é ok")


def test_chunk_ids_past_a_million_chunks_and_long_conversations(spark):
    """Ids of (document, chunk) and (conversation, turn) stay apart whatever
    either part's size."""
    from guardspark.functions.text import pair_id
    wide = spark.range(3).crossJoin(spark.range(0, 1 << 21, 1 << 10).withColumnRenamed("id", "part"))
    assert wide.select(pair_id("id", "part").alias("i")).distinct().count() == 3 * (1 << 11)
    turns = spark.createDataFrame([(c, t) for c in range(4) for t in range(1500)], "conv long, turn long")
    assert turns.select(pair_id("conv", "turn").alias("i")).distinct().count() == 6000


def test_event_details_of_every_kind_survive_the_log(spark):
    d = _tmp()
    with open(os.path.join(d, "log.json"), "w") as f:
        f.write('[{"timestamp": "2024-05-01T10:00:00", "event_type": "A", "details": {"categories": "one", "issues": ["x"], '
                '"regex_score": 0.5, "semantic_score": 0.25, "category_votes": {"k": 2}, "type": "t"}}, '
                '{"timestamp": "2024-05-01T11:00:00", "event_type": "B", "details": {"categories": ["p", "q"]}}, {"event_type": "C"}]')
    got = E.load_events(spark, d, fmt="json", json_array=True)
    E.append_events(got.drop("_corrupt_record"), f"{d}/table")
    for t in (got, E.load_events(spark, f"{d}/table")):
        r = {x.event_type: x.details for x in t.collect()}
        assert r["A"].categories == ["one"] and r["A"].issues == ["x"] and r["A"].category_votes == {"k": 2}
        assert (r["A"].regex_score, r["A"].semantic_score, r["A"].type) == (0.5, 0.25, "t")
        assert r["B"].categories == ["p", "q"] and r["B"].issues is None


def test_files_are_written_without_a_folder_each(spark):
    import tempfile
    d = tempfile.mkdtemp() + "/files"
    rows = spark.range(300).selectExpr("concat('n=', id, '.txt') AS name", "CAST(concat('text ', id) AS BINARY) AS content")
    assert C.write_files(rows, d, folders=4) == 300
    assert C.write_files(rows, d, folders=4) == 300                 # a task that runs again
    got = C.scan_text_corpus(spark, d).collect()
    assert {r.source_file: bytes(r.content).decode() for r in got} == {f"n={i}.txt": f"text {i}" for i in range(300)} and len(got) == 300
    assert len({r.path.rsplit("/", 1)[0] for r in got}) == 4
    assert C.write_files(rows.where("false"), d) == 0


def test_rows_of_one_id_share_a_scanned_file(spark, tmp_path):
    from guardspark.plans.file_queries import scan_text_corpus_q
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (-5, "x" * 4000), (13, "j"), (None, "n")], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.n_bytes, r.reason) for r in scan_text_corpus_q(spark, str(tmp_path)).collect()}
    assert got == {1: (4, ""), 2: (1, ""), -5: (4001, "larger than 4000 bytes"), 13: (13, 'unsupported type ".json"')}


def test_bytes_are_decoded_in_slices(spark):
    """Texts longer than a slice, runs of short ones, and nulls, in their rows."""
    from guardspark.functions.slices import runs
    from guardspark.plans.file_queries import _encoded
    import pyarrow as pa
    assert runs(pa.array(["x" * 60, None, "y" * 30, "z" * 500, "", "w"]), 100) == [(0, 3), (3, 6)]
    assert runs(pa.array([], pa.binary())) == []
    how = ["utf-8", "utf-8-sig", "utf-16", "malformed", None]
    texts = [None if i % 9 == 0 else "é" * (1_500_000 if i == 13 else i * 700) for i in range(60)]
    rows = [(i, t, how[i % 5]) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id long, text string, how string").coalesce(1).withColumn("content", _encoded())
    got = {r.id: r.text for r in C.decode_text(df.drop("text")).collect()}
    assert got == {i: t if t is None or h != "malformed" else t + "��" for i, t, h in rows}
