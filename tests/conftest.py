import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    import vigilog
    import workload
    from vigilog.session import configure, ship_code

    builder = SparkSession.builder.master("local[8]").appName("tests").config("spark.sql.shuffle.partitions", "8")
    builder = builder.config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
    builder = builder.config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("scratch")))
    session = configure(builder.config("spark.ui.showConsoleProgress", "false")).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    ship_code(vigilog, workload)
    yield session
    session.stop()


@pytest.fixture
def tiny_limits(monkeypatch):
    """Limits so low that every lookup is joined by shuffle, keys are hot and cells are cut up."""
    from vigilog.operators import joins, knn

    monkeypatch.setattr(joins, "MAX_LOOKUP_ROWS", 0)
    monkeypatch.setattr(joins, "HOT_KEY_ROWS", 3)
    monkeypatch.setattr(knn, "BLOCK_ROWS", 7)
    monkeypatch.setattr(knn, "CHUNK_ROWS", 5)
    monkeypatch.setattr(knn, "BUNDLE_ROWS", 40)
    monkeypatch.setattr(knn, "SCORES_AT_ONCE", 20)


def pairs(df, *columns):
    return {tuple(r) for r in df.select(*columns).collect()}
