import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ":".join(x for x in (ROOT, f"{ROOT}/tests", os.environ.get("PYTHONPATH")) if x)
SMALL = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SMALL


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def plain(value):
    """A value that compares and sorts alike whatever engine it came from."""
    if isinstance(value, float):
        return round(value, 9)
    if isinstance(value, (list, tuple)):
        return tuple(plain(x) for x in value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(x)) for k, x in value.items()))
    return bytes(value) if isinstance(value, bytearray) else value


def same_rows(frame, relation):
    """Whether a DataFrame and a DuckDB relation have equal columns and rows, order apart."""
    columns = sorted(frame.columns)
    assert columns == sorted(relation.columns)
    ours = frame.select(*[frame[f"`{c}`"] for c in columns]).toArrow().to_pylist()
    theirs = relation.select(", ".join(f'"{c}"' for c in columns)).to_arrow_table().to_pylist()
    key = lambda rows: sorted((tuple(plain(v) for v in r.values()) for r in rows), key=repr)
    return key(ours) == key(theirs)
