from __future__ import annotations

import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from paneldrift.operators.scale import release_tables, run_folder  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    release_tables(session)
    assert not os.path.exists(run_folder(session))


def rows(df, *columns: str) -> list[tuple]:
    """Rows as sorted tuples, doubles rounded."""

    def plain(v):
        return round(v, 6) if isinstance(v, float) else v

    return sorted(
        (tuple(plain(r[c]) for c in columns or df.columns) for r in df.collect()), key=repr
    )
