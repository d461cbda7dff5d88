import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, n string, key string, pivots string"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from texts or (id, text[, source]) rows, with columns whose names operators use inside."""
    def build(rows):
        full = []
        for k, row in enumerate(rows):
            row = row if isinstance(row, tuple) else (k, row)
            source = row[2] if len(row) > 2 else "s"
            full.append((row[0], row[1], "en", source, len(row[1] or ""), "x", "y", "z", "w"))
        return spark.createDataFrame(full, SCHEMA)

    return build

