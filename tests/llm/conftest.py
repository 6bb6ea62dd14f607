import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs_of(spark):
    """docs_of(rows of (doc_id, text)): a documents table, with a column that operators use inside."""

    def make(rows, **more):
        from pyspark.sql import functions as F

        df = spark.createDataFrame([(i, t, more.get("lang", "en"), "s", len(t or "")) for i, t in rows], SCHEMA)
        for clash in ("row", "keep", "fp", "group", "key", "known", "words", "pos", "h1", "start", "length"):
            df = df.withColumn(clash, F.lit("clash"))
        return df

    return make


@pytest.fixture
def odd():
    """Null, empty, blank, tied, repeated and very long texts; null and repeated ids."""
    shared = "This very line is shared by a good many documents, word for word."
    long_text = " ".join(f"word{i % 977} and" for i in range(30000))
    rows = [(i, f"{shared}\nOwn line number {i} of this document which is long enough too.\n  {shared.upper()}  ") for i in range(7)]
    rows += [(20, None), (21, ""), (22, " \n\t "), (23, long_text), (23, long_text), (None, shared), (None, None), (24, "A"), (25, "x" * 5000), (26, "żółć 漢字 \U0001f600 ok"), (3, "Another text under a doc_id that is there already.")]
    return rows
