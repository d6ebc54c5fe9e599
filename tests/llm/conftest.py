import pytest

#: Texts with nothing, blanks, repeats, marks of other scripts and no blanks at all.
ODD = [None, "", " ", "\n", "a", "a\na\n", "  a  b ", "a\nb\t c", "é é é é é\x0b\n \n\n", "ﬁ é é Ａ　x", "<s> a</s>", "\x00a", "▁a ▁",
       "a" * 3000, "日本語 テキスト", "  \n  x\n\n", "it's 12345 😀😀", "<|endoftext|> x", "a \n \nb", "x   y", "AbC aBc abc", "no\xa0break"]


@pytest.fixture(scope="session")
def texts():
    """The smallest documents table and the odd texts, some of them twice."""
    import duckdb
    rows = duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.001/documents.parquet' ORDER BY 1").fetchall()
    top = rows[-1][0] + 1
    return rows + [(top + i, t) for i, t in enumerate(ODD + ODD[:5])]


@pytest.fixture(scope="session")
def docs(spark, texts):
    """With columns whose names the operators use themselves."""
    rows = [(i, t, "x", 1, 2) for i, t in texts]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, n_words int, row int").repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, ids string, n_words int, row int")
