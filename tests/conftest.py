"""One local Spark session for all tests, and small builders."""

import os
import sys
from datetime import datetime

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from checks.compare import local_session  # noqa: E402
from trackweave import Network  # noqa: E402

OBSERVATION = "user_id bigint, ts timestamp, weekday int, hour int, coord_x double, coord_y double"


@pytest.fixture(scope="session")
def spark():
    session = local_session("4")
    yield session
    session.stop()


def at(text: str) -> datetime:
    """A UTC time, naive as the session expects it."""
    return datetime.fromisoformat(text)


@pytest.fixture(scope="session")
def observed(spark):
    """Observations from (user, time text, x), with weekday and hour filled in."""

    def build(rows):
        filled = []
        for user, text, x in rows:
            ts = at(text)
            filled.append((user, ts, ts.isoweekday(), ts.hour, float(x), 0.0))
        return spark.createDataFrame(filled, OBSERVATION)

    return build


@pytest.fixture(scope="session")
def line_network(spark):
    """Cells A, B, C at x = 1, 2, 3 in a line: ring 1 is the next cell."""
    cells = spark.createDataFrame(
        [("A", 1.0, 0.0), ("B", 2.0, 0.0), ("C", 3.0, 0.0)],
        "cell_id string, coord_x double, coord_y double",
    )
    adjacency = spark.createDataFrame(
        [(c, c, 0) for c in "ABC"]
        + [("A", "B", 1), ("B", "A", 1), ("B", "C", 1), ("C", "B", 1)],
        "cell_id string, neighbor_id string, ring_order int",
    )
    return Network(cells, adjacency)


def as_matrix(df, value: str) -> dict:
    return {(r.from_no, r.to_no): r[value] for r in df.collect()}
