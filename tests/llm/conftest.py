import pytest
from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"


def long_text():
    """Many words, many lines, one word without an end."""
    lines = [" ".join(f"w{(i * 7 + j * 13) % 5003}" for j in range(40)) for i in range(1500)]
    return "\n".join(lines) + "\n" + "x" * 100_000


BASE = " ".join(f"alpha{i}" for i in range(60))

#: Texts that every operator meets: nulls, blanks, copies, near copies, ties.
TEXTS = [
    (0, BASE), (1, BASE), (2, BASE.replace("alpha30", "other")), (3, BASE.upper()),
    (4, None), (5, ""), (6, " \t\n\x0b\x0c\r "), (7, "one two three"), (8, "one  two\tthree"),
    (9, "one two three four"), (10, "!!! ### $$$"), (11, "é" * 30 + " ß ü   日本語 текст"), (12, "a\nb\n\na\nb\n"),
    (13, "x " * 400), (14, long_text()), (15, "tail <|endoftext|> here  \n\n  's 're end "), (None, BASE), (None, None),
    (16, BASE + "\n" + BASE), (16, BASE + "\n" + BASE), (17, "1 2 3 4"), (18, "\x1c\x1d sep \x85 nbsp\xa0x"),
]

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # Names that the operators use inside.
    *(T.StructField(c, T.StringType()) for c in ("_row", "_t", "_id", "_text", "_key", "_h", "_w", "n", "rep", "key", "path",
                                                  "h", "bucket", "epoch", "rank", "n_words", "part", "x", "a", "b", "_n_lines"))])


def rows(texts):
    out = []
    for i, (doc, text) in enumerate(texts):
        lang, source = [None, "en", "de"][i % 3], [None, "src0", "src1", "odd"][i % 4]
        out.append((doc, text, lang, source, None if text is None else len(text), *["clash"] * 21))
    return out


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(rows(TEXTS), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
