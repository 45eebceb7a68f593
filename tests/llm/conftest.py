import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """docs([(id, text), ...]) or with lang and source: a documents table."""
    def make(rows, partitions=3):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "src0", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, DOC_SCHEMA).repartition(partitions)
    return make


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}
