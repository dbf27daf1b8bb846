import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from maskloom.session import build_session

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.default.parallelism": "8", "spark.driver.memory": "8g"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").cache()


@pytest.fixture(scope="session")
def texts(documents):
    return [r["text"] for r in documents.orderBy("doc_id").collect()]


@pytest.fixture
def texts_frame(spark):
    """Strings as a table with keys from 0."""

    def make(strings):
        return spark.createDataFrame(list(enumerate(strings)), "doc_id long, text string")

    return make
