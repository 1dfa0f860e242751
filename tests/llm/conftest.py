import duckdb
import pytest

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_rows():
    return duckdb.sql(f"SELECT doc_id, text, lang, source, n_chars FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()


@pytest.fixture(scope="session")
def edge_rows():
    """NULLs, empty and long texts, ties, repeated rows."""
    long = " ".join(f"word{i % 97} x{i}" for i in range(30_000))
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "no id here at all today", "en", "s", 5),
            (3, "Same Text Here Now Ok", "en", "s", 1), (4, "same text here now ok", "en", "s", 1),
            (4, "same text here now ok", "en", "s", 1), (5, " \t\n ", "en", "s", 1), (6, "ünïcode ÀÉ ß", "de", "s", 1),
            (7, long, "en", "s", 1), (8, long + " tail", "en", "s", 1), (9, "1" * 50_000, "en", "s", 1),
            (10, "a" * 30_000, "en", "s", 1), (11, "12345 67890", None, "s", 1)]
    return rows


@pytest.fixture(scope="session")
def frame(spark):
    def make(rows, schema=DOC, extra=True):
        df = spark.createDataFrame(rows, schema)
        if extra:  # columns that carry the names of results and helpers
            for c in ("component_id", "score", "position", "bucket", "row", "held_out", "fp", "kept", "sequence_id"):
                df = df.selectExpr("*", f"'x' AS {c}")
        return df
    return make
