import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Documents from (doc_id, text, lang, source), spread over a few partitions."""
    def make(rows, schema=SCHEMA):
        full = [(*r, None if r[1] is None else len(r[1])) for r in rows] if schema == SCHEMA else rows
        return spark.createDataFrame(full, schema).repartition(3)
    return make


@pytest.fixture
def table_folder(tmp_path):
    """A folder of Parquet tables for a query."""
    def write(**tables):
        folder = str(tmp_path / f"tables{len(list(tmp_path.iterdir()))}")
        for name, df in tables.items():
            df.write.parquet(f"{folder}/{name}.parquet")
        return folder
    return write
