import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = (SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4")
         .config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.python.sql.dataFrameDebugging.enabled", "false")
         .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture
def ledger(spark):
    """Builds a fact ledger out of dicts; missing fields take the defaults of a plain verified fact."""
    import datetime as dt

    defaults = dict(
        fact_id=None, document_id="doc-real-001", metric_code="COAL_PRODUCTION", org="SECL",
        field=None, site=None, reporting_period="FY 2024-25", temporal_grain=None,
        numeric_value=10.0, unit="MT", confidence_score=0.95, validation_status="VERIFIED",
        is_demo=False, extraction_method="STRUCTURED_TABLE", sheet_name=None, page_number=None,
        row_number=None, cell_reference=None)
    schema = (
        "fact_id string, document_id string, metric_code string, org string, field string, "
        "site string, reporting_period string, temporal_grain string, numeric_value double, "
        "unit string, confidence_score double, validation_status string, is_demo boolean, "
        "extraction_method string, sheet_name string, page_number int, row_number int, "
        "cell_reference string, human_verified boolean, created_at timestamp")

    def build(*rows):
        out = []
        for i, r in enumerate(rows):
            full = defaults | r
            full["fact_id"] = full["fact_id"] or f"f{i:04d}"
            full["human_verified"] = full["validation_status"] == "VERIFIED"
            full["created_at"] = r.get("created_at") or dt.datetime(2025, 1, 1) + dt.timedelta(minutes=i)
            out.append(tuple(full[c.split()[0]] for c in schema.split(", ")))
        return spark.createDataFrame(out, schema)

    return build
