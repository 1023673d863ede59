from __future__ import annotations

import sys
from datetime import date, datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from tillwright.operators.cleaning import clean_transactions  # noqa: E402
from tillwright.session import build_session  # noqa: E402

RAW = (
    "invoice string, stock_code string, description string, quantity bigint, invoice_ts timestamp, "
    "price decimal(12,2), customer_id bigint, country string"
)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests", "local[4]", spark__sql__shuffle__partitions="4", spark__driver__memory="8g",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")),
    )
    session.sparkContext.setCheckpointDir(session.conf.get("spark.checkpoint.dir"))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_raw(spark):
    """Raw lines from (invoice, code, description, quantity, 'yyyy-mm-dd hh:mm', price, customer, country)."""

    def build(rows):
        parsed = [
            (*r[:4], r[4] and datetime.strptime(r[4], "%Y-%m-%d %H:%M"), r[5], r[6], r[7]) for r in rows
        ]
        frame = spark.createDataFrame(
            parsed, RAW.replace("decimal(12,2)", "double")
        )
        return frame.withColumn("price", F.col("price").cast("decimal(12,2)"))

    return build


@pytest.fixture(scope="session")
def four_lines(make_raw):
    """The four-line investigation fixture: three lines on 2011-12-09 and one on the next day."""
    return clean_transactions(make_raw([
        ("1001", "A", "Product A", 10, "2011-12-09 09:00", 10.0, 100, "United Kingdom"),
        ("1002", "A", "Product A", 20, "2011-12-09 10:00", 10.0, 100, "United Kingdom"),
        ("1003", "B", "Product B", 5, "2011-12-09 09:00", 20.0, 200, "Germany"),
        ("1004", "B", "Product B", 10, "2011-12-10 09:00", 20.0, 200, "Germany"),
    ]))


@pytest.fixture(scope="session")
def the_day(spark):
    return spark.createDataFrame([(date(2011, 12, 9),)], "date date")


@pytest.fixture(scope="session")
def ramp(spark):
    """80 days from 2020-01-01 with revenue rising from 1000 to 3000."""
    rows = [
        (date(2020, 1, 1) + timedelta(i), 1000 + 2000 * i / 79, 20 + i, 10 + i, 100 + i, (1000 + 2000 * i / 79) / (20 + i))
        for i in range(80)
    ]
    return spark.createDataFrame(
        rows, "date date, revenue double, orders bigint, customers bigint, units_sold bigint, aov double"
    )


@pytest.fixture(scope="session")
def series(spark):
    """A daily table from a list of revenues (None leaves a calendar gap)."""

    def build(revenues, start=date(2020, 1, 1)):
        rows = [(start + timedelta(i), float(r)) for i, r in enumerate(revenues) if r is not None]
        return spark.createDataFrame(rows, "date date, revenue double")

    return build
