import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from quire.session import build_session

    session = build_session(
        "local[8]",
        "quire-tests",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.driver.memory": "8g",
            "spark.ui.enabled": "false",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make(spark):
    """Elements from dicts, with all canonical columns."""
    from quire.schema import ELEMENT_COLUMNS, conform

    def build(*rows):
        names = [c for c in ELEMENT_COLUMNS if any(c in r for r in rows)]
        schema = ", ".join(f"`{n}` {ELEMENT_COLUMNS[n]}" for n in names)
        full = [{"doc_id": 1, "element_index": i, "source": "a.txt", **r} for i, r in enumerate(rows)]
        names = [c for c in ELEMENT_COLUMNS if any(c in r for r in full)]
        schema = ", ".join(f"`{n}` {ELEMENT_COLUMNS[n]}" for n in names)
        return conform(spark.createDataFrame([tuple(r.get(n) for n in names) for r in full], schema))

    return build
