import duckdb
import pytest

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def rows():
    """Rows of a driver table, read without Spark."""
    def read(name, columns):
        con = duckdb.connect()
        return con.execute(f"SELECT {columns} FROM '{FOLDER}/{name}.parquet' ORDER BY 1").fetchall()
    return read


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with every awkward case: NULLs, blanks, copies, ties, extra columns
    with names that operators use inside."""
    texts = [None, "", " \n\t ", "one two three four five", "one two three four five", "x" * 300, "é\U0001F600ç " * 40, "same line here now ok\n" * 30,
             "A" * 5000 + " b", "password = hunter2hunter2", "\r\n\r\nWARC/1.0\r\n\r\n", "<|endoftext|> tail", "a\x1cb \x1c c", "  lead and   gaps  "]
    data = [(i, t, "en", "src0" if i % 2 else None, len(t or ""), "keep", i * 7) for i, t in enumerate(texts)]
    data += [data[3], data[7], (None, "no id at all, five words more", None, None, 0, None, None)]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, id string, kept long")
