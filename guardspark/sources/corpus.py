"""Corpus sources and the chunk table: read text files, decode, ingest,
append, delete, clear and report.

The chunk table is plain parquet: ``id, doc_id, source_file, chunk_index,
start_index, end_index, content, vector``. Chunk ids are hashes of
(doc_id, chunk_index), computed row by row, so appends need no global sort or
counter and neither part has a bound.
"""
from __future__ import annotations

from typing import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.patterns import MAX_FILE_BYTES, TEXT_SUFFIXES
from ..functions.slices import runs
from ..functions.text import clean_text, pair_id
from ..functions.vectors import HASHED
from ..operators.chunking import chunk_documents
from ..session import ship_package, stored
from .chunk_table import metadata_map

LISTED_ROWS = 10_000             # of a folder as Python objects at once
TASK_FILES, TASK_BYTES = 8_192, 256 << 20     # that a task reads at most, about
READ_BYTES = 4 << 20             # of contents held at a time, or one file


def _case_glob(suffix: str) -> str:
    return "*." + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in suffix.lstrip("."))


def write_files(df: DataFrame, path: str, folders: int = 256) -> int:
    """One file per row of (``name``, ``content`` as bytes) below ``path``,
    dealt over ``folders``, and their number. The tasks write the files
    themselves: no folder and no commit step per file. A task that runs again
    replaces its files, and none is seen half written. ``path``: a shared
    folder that pyarrow's file systems can open."""
    folder = F.pmod(F.xxhash64("name"), F.lit(folders)).cast("int").alias("folder")

    def write(batches):
        import uuid

        import pyarrow as pa
        from pyarrow import fs
        store, root = fs.FileSystem.from_uri(path)
        made = set()
        for b in batches:
            for folder, name, content in zip(*(b.column(i).to_pylist() for i in range(3))):
                at = f"{root}/folder={folder}"
                if folder not in made:
                    store.create_dir(at, recursive=True)
                    made.add(folder)
                part = f"{root}/_part-{uuid.uuid4().hex}"
                with store.open_output_stream(part) as out:
                    out.write(content)
                store.move(part, f"{at}/{name}")
            yield pa.RecordBatch.from_pydict({"n": pa.array([b.num_rows], pa.int64())})

    return df.select(folder, "name", "content").mapInArrow(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def list_text_corpus(spark: SparkSession, path: str, suffixes=TEXT_SUFFIXES) -> DataFrame:
    """Files with an allowed suffix (compared case-insensitively) under
    ``path``; the suffix is part of the listing, so other files are not read."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
                 .option("pathGlobFilter", "{" + ",".join(map(_case_glob, suffixes)) + "}").load(path)
                 .withColumn("source_file", F.element_at(F.split("path", "/"), -1)))


def scan_text_corpus(spark: SparkSession, path: str, suffixes=TEXT_SUFFIXES, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """Text files of at most ``max_bytes``; see :func:`rejected_files`."""
    return list_text_corpus(spark, path, suffixes).where(F.col("length") <= max_bytes) \
        .select("path", "source_file", "length", "content")


def rejected_files(spark: SparkSession, path: str, suffixes=TEXT_SUFFIXES, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """Text files that are too large, with the reason (no content is read)."""
    return (list_text_corpus(spark, path, suffixes).where(F.col("length") > max_bytes)
            .select("path", "source_file", "length", F.format_string("larger than %d bytes", F.lit(max_bytes)).alias("reason")))


def _listing(spark: SparkSession, path: str) -> DataFrame | None:
    """(``path`` as the binary file source writes it, ``length``, ``at`` as
    pyarrow's file systems take it) of all files below a folder, without those
    that Spark's sources leave out. Tasks list the folders, level by level, and
    store what they find; the driver sees no file. None: pyarrow opens no
    folder there."""
    from pyarrow import fs
    ship_package(spark)
    try:
        store, root = fs.FileSystem.from_uri(path)
        if store.get_file_info(root).type != fs.FileType.Directory:
            return None
    except (pa.ArrowException, OSError):
        return None
    local, root = isinstance(store, fs.LocalFileSystem), root.rstrip("/")
    base = f"file:{root}" if local else path.rstrip("/")

    def entries(batches):
        import pyarrow as pa
        from pyarrow import fs
        store, _ = fs.FileSystem.from_uri(path)
        for b in batches:
            for folder in b.column(0).to_pylist():
                found = store.get_file_info(fs.FileSelector(folder))
                for lo in range(0, len(found), LISTED_ROWS):
                    rows = [(base + f.path[len(root):], f.size if f.is_file else None, f.path) for f in found[lo:lo + LISTED_ROWS]
                            if f.type in (fs.FileType.File, fs.FileType.Directory) and not _left_out(f.base_name)]
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string()))],
                                                     names=["path", "length", "at"])

    slots = spark.sparkContext.defaultParallelism
    level, n, levels = spark.createDataFrame([(root or "/",)], "at string").coalesce(1), 1, []
    while n:
        levels.append(stored(level.mapInArrow(entries, "path string, length long, at string"), "listing"))
        level = levels[-1].where("length is null").select("at")
        n = level.count()
        level = level.repartition(min(n, slots)) if n else level
    files = levels[0]
    for more in levels[1:]:
        files = files.unionByName(more)
    return files.where("length > 0")


def _left_out(name: str) -> bool:
    """Names that Spark's file sources take for hidden or unfinished."""
    return (name.startswith("_") and "=" not in name and not name.startswith(("_metadata", "_common_metadata"))
            or name.startswith(".") or name.endswith("._COPYING_"))


def _with_content(files: DataFrame, path: str) -> DataFrame:
    """Rows of :func:`_listing` with the files' ``content`` instead of ``at``,
    read by tasks that are dealt alike numbers of them; a task holds about
    READ_BYTES at a time, or one file."""
    n, total = files.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
    slots = files.sparkSession.sparkContext.defaultParallelism
    parts = max(1, min(n, slots), -(-n // TASK_FILES), -(-total // TASK_BYTES))

    def read(batches):
        import pyarrow as pa
        from pyarrow import fs
        store, _ = fs.FileSystem.from_uri(path)

        def rows(b, lo, content):
            part = b.slice(lo, len(content))
            return pa.RecordBatch.from_arrays([*(part.column(c) for c in ("path", "source_file", "length")), pa.array(content, pa.binary())],
                                              names=["path", "source_file", "length", "content"])

        for b in batches:
            lo, held, content = 0, 0, []
            for at in b.column("at").to_pylist():
                with store.open_input_file(at) as f:
                    content.append(f.read())
                held += len(content[-1])
                if held >= READ_BYTES:
                    yield rows(b, lo, content)
                    lo, held, content = lo + len(content), 0, []
            if content:
                yield rows(b, lo, content)

    return (files.select("path", "source_file", "length", "at").repartition(parts)
                 .mapInArrow(read, "path string, source_file string, length long, content binary"))


def scan_with_rejects(spark: SparkSession, path: str, suffixes=TEXT_SUFFIXES, max_bytes: int = MAX_FILE_BYTES) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) files under ``path``, from one listing of all of
    them: text files of at most ``max_bytes`` with their content, and every
    other file with the reason (its content is not read). Empty files hold no
    text and are not listed. Tasks list and read what pyarrow's file systems
    open, so the driver's memory does not grow with the number of files; other
    paths (and patterns of paths) go through Spark's binary file source, which
    lists on the driver."""
    listed = _listing(spark, path)
    by_tasks = listed is not None
    if not by_tasks:
        listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    listed = listed.withColumn("source_file", F.element_at(F.split("path", "/"), -1))
    name = F.lower("source_file")
    suffix = F.when(F.contains(name, F.lit(".")), F.concat(F.lit("."), F.element_at(F.split(name, r"\."), -1))).otherwise(F.lit(""))
    reason = (F.when(~suffix.isin(*suffixes), F.format_string('unsupported type "%s"', suffix))
               .when(F.col("length") > max_bytes, F.format_string("larger than %d bytes", F.lit(max_bytes))))
    files = listed.withColumn("reason", reason)
    taken = files.where("reason is null")
    return (_with_content(taken, path) if by_tasks else taken.select("path", "source_file", "length", "content"),
            files.where("reason is not null").select("path", "source_file", "length", "reason"))


def decode_text(df: DataFrame, content_col: str = "content", out_col: str = "text",
                fallback_charset: str | None = None) -> DataFrame:
    """Bytes to text: UTF-16 by byte-order mark, UTF-8 (BOM dropped) when
    valid, else ``fallback_charset`` if given, else UTF-8 with U+FFFD for
    invalid sequences. No bytes fail the job: what a charset cannot decode
    becomes U+FFFD. Python holds slices of a batch (:mod:`slices`), not all of
    it."""
    names = {"ISO-8859-1": "latin-1"}

    def decoder(charset):
        def run(batches):
            for whole in batches:
                for lo, hi in runs(whole):
                    yield pa.array([None if b is None else b.decode(charset, errors="replace")
                                    for b in whole.slice(lo, hi - lo).to_pylist()], pa.string())
        run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
        return F.arrow_udf(run, "string")

    b = F.col(content_col)
    head2 = F.hex(F.substring(b, 1, 2))
    utf16 = head2.isin("FFFE", "FEFF")
    utf8 = F.when(F.hex(F.substring(b, 1, 3)) == "EFBBBF", F.expr(f"substring({content_col}, 4)")).otherwise(b)
    valid = F.is_valid_utf8(b.cast("string"))
    # Only the rows that need a tolerant decoder send bytes to Python.
    wide = decoder("utf-16")(F.when(utf16, b))
    other = F.make_valid_utf8(b.cast("string")) if fallback_charset is None else \
        decoder(names.get(fallback_charset, fallback_charset))(F.when(~utf16 & ~valid, b))
    return df.withColumn(out_col, F.when(utf16, wide).when(valid, utf8.cast("string")).otherwise(other))


def ingest_corpus(docs: DataFrame, doc_id: str = "doc_id", text_col: str = "text",
                  source_col: str = "source_file", embedder=HASHED, metadata_cols: list[str] | None = None) -> DataFrame:
    """Clean, chunk and embed documents into chunk-table rows (blank
    documents produce no rows). With ``metadata_cols`` every chunk carries
    those columns of its document as a ``metadata`` map."""
    extra = [] if metadata_cols is None else [metadata_map(metadata_cols).alias("metadata")]
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(source_col).alias("source_file"), *extra,
                    clean_text(text_col).alias("text"))
    kept = ["doc_id", "source_file"] + ["metadata"] * len(extra)
    ch = chunk_documents(d, "text", kept)
    return (ch.withColumn("id", pair_id("doc_id", "chunk_index"))
              .withColumn("vector", embedder.column("content"))
              .select("id", *kept, "chunk_index", "start_index", "end_index", "content", "vector"))


def save_chunks(chunks: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Persist the chunk table (bucketing by ``id`` is left to the catalog)."""
    chunks.write.mode(mode).parquet(path)


def load_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def append_chunks(chunks: DataFrame, path: str) -> None:
    """Append new chunk rows; ids come from their documents, so no
    coordination with existing rows is needed (re-ingesting a document
    appends duplicates, as re-uploading a file does)."""
    chunks.write.mode("append").parquet(path)


def delete_by_source(spark: SparkSession, path: str, source_file: str, out_path: str) -> int:
    """Write the table without ``source_file`` to ``out_path``; return the
    number of rows removed (rows without a source stay). The caller swaps
    paths; :func:`chunk_table.delete_sources` deletes in place."""
    t = load_chunks(spark, path)
    gone = F.col("source_file").eqNullSafe(F.lit(source_file))
    removed = t.where(gone).count()
    t.where(~gone).write.mode("overwrite").parquet(out_path)
    return removed


def clear_chunks(spark: SparkSession, path: str, schema) -> None:
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)


def corpus_status(chunks: DataFrame) -> DataFrame:
    """Chunks, documents and characters per source (one row per source)."""
    return chunks.groupBy("source_file").agg(F.count(F.lit(1)).alias("n_chunks"),
                                             F.countDistinct("doc_id").alias("n_docs"),
                                             F.sum(F.length("content")).cast("bigint").alias("n_chars"))
