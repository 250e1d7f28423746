import pytest

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def documents(spark):
    """A DataFrame of documents from (doc_id, text) or whole rows, with an extra column of a clashing name."""

    def make(rows, extra=True):
        full = [(*r, "en", f"src{(r[0] or 0) % 3}", len(r[1] or "")) if len(r) == 2 else r for r in rows]
        df = spark.createDataFrame(full, DOCUMENTS)
        if extra:
            for name in ("score", "kept", "key", "rank", "vid", "label", "n", "position", "comp", "token", "a"):
                from pyspark.sql import functions as F

                df = df.withColumn(name, F.lit("x"))
        return df

    return make
