import pytest
from pyspark.sql import functions as F  # noqa: F401


@pytest.fixture(scope="session")
def docs_of(spark):
    def make(rows, schema="doc_id long, text string, lang string, source string, n_chars long"):
        return spark.createDataFrame([(*r, *[None] * (schema.count(",") + 1 - len(r))) for r in rows], schema)

    return make
