import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Column names that operators use inside, as extra columns of their input.
CLASHING = ("size", "target", "source_size", "rate", "copies", "fp", "component_id", "word", "idx", "k1", "k2", "score", "n", "label_", "gone")


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from texts or (doc_id, text[, source]) tuples, with clashing extra columns."""
    from pyspark.sql import functions as F

    def make(items, extra=True):
        rows = []
        for k, x in enumerate(items):
            x = x if isinstance(x, tuple) else (k, x)
            rows.append((x[0], x[1], "en", x[2] if len(x) > 2 else f"s{k % 2}", None if x[1] is None else len(x[1])))
        df = spark.createDataFrame(rows, DOC_SCHEMA)
        return df.withColumns({c: F.lit("x") for c in CLASHING}) if extra else df
    return make
