import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from texts, or from (doc_id, text, source) tuples."""

    def make(rows, extra=False):
        rows = [r if isinstance(r, tuple) else (i, r, "s") for i, r in enumerate(rows)]
        df = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)
        if extra:  # columns whose names an operator may use itself
            from pyspark.sql import functions as F

            for c in ("a", "b", "n", "part", "word", "line", "rank", "score", "length", "start", "kept", "key", "h", "copies", "tokens", "total", "block", "row"):
                df = df.withColumn(c, F.lit("x"))
        return df

    return make


ODD_TEXTS = [None, "", " ", "\n", "a", "a a a", "x" * 5000, "word " * 3000, "Ünïcödé ß ñ «quoted» 漢字かな 🎉", "tab\tand\x0bother\x0c\rblanks", "same text twice over here", "same text twice over here", "<|endoftext|> in text <|endoftext|>", "a..b ,c ,,d %%%. e", "3.14 and 1,000,000.50", " nbsp ", "zero\x00byte", "multi  space   here\n\n\nlines"]


@pytest.fixture(scope="session")
def odd_texts():
    return list(ODD_TEXTS)
