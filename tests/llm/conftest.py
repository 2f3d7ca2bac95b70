import pytest
from pyspark.sql import types as T

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """Rows of (doc_id, text, lang, source) as a documents frame."""
    def build(rows, parts=3):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "src1", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, DOCS).repartition(parts)
    return build


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], T.StructType.fromDDL(DOCS) if hasattr(T.StructType, "fromDDL") else DOCS)
