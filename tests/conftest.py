import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ledgerlynx.session import build_session  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false",
        "spark.driver.memory": "6g", "spark.python.sql.dataFrameDebugging.enabled": "false"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder():
    return FOLDER


@pytest.fixture(scope="session")
def invoices(spark, folder):
    from ledgerlynx.sources.invoices import load_invoices

    return load_invoices(spark, folder).persist()


@pytest.fixture
def make(spark):
    """Invoices from partial dicts; unnamed fields take plain defaults."""
    from ledgerlynx.schemas import INVOICE_COLUMNS
    import datetime as dt

    plain = {
        "vendor_id": "V1", "amount": 100.5, "tax": 7.0, "bank_account": "A1",
        "ts": dt.datetime(2024, 1, 3, 12), "description": "fee", "category": "IT",
        "payment_method": "ACH"}
    schema = ("invoice_id string, vendor_id string, amount double, tax double, "
              "bank_account string, ts timestamp, description string, category string, "
              "payment_method string")

    def build(*rows):
        full = [{"invoice_id": f"I{i}", **plain, **r} for i, r in enumerate(rows)]
        return spark.createDataFrame([tuple(r[c] for c in INVOICE_COLUMNS) for r in full], schema)

    return build
