"""Run registered queries and their SQL side by side.

``python -m checks.compare [folder] [query ...]``
"""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

from .oracles import ORACLES
from .queries import REGISTRY


def local_session(cpus: str = "8") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("trackweave")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    """An in-process database with a view per table file."""
    connection = duckdb.connect()
    for path in sorted(glob.glob(os.path.join(sf_dir, "*.parquet"))):
        name = os.path.splitext(os.path.basename(path))[0]
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def _plain(frame):
    frame = frame[sorted(frame.columns)]
    return frame.astype(object).where(frame.notna(), None)


def differences(frame, expected) -> str:
    """Empty if both pandas frames hold the same rows, else what differs."""
    got, want = _plain(frame), _plain(expected)
    if list(got.columns) != list(want.columns):
        return f"columns {list(got.columns)} != {list(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    rows = [sorted(map(repr_row, f.itertuples(index=False))) for f in (got, want)]
    wrong = [(a, b) for a, b in zip(*rows) if a != b]
    return f"{len(wrong)} values, first {wrong[0]}" if wrong else ""


SQL_TYPES = {
    "int": "INTEGER",
    "bigint": "BIGINT",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
}


def type_differences(frame, relation) -> str:
    """Empty if a Spark frame and a SQL result have the same column types."""
    got = {f.name: SQL_TYPES.get(f.dataType.simpleString(), "?") for f in frame.schema}
    want = {name: str(kind) for name, kind in zip(relation.columns, relation.types)}
    return "" if got == want else f"types {got} != {want}"


def repr_row(row) -> str:
    return repr([float(v) if isinstance(v, (int, float)) else v for v in row])


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(REGISTRY)
    spark, connection = local_session(), database(sf_dir)
    failed = 0
    for name in names:
        begin = time.time()
        result = REGISTRY[name](spark, sf_dir)
        frame = result.toPandas()
        middle = time.time()
        if name in ORACLES:
            relation = connection.sql(ORACLES[name])
            problem = type_differences(result, relation) or differences(frame, relation.df())
        else:
            problem = "no SQL"
        failed += bool(problem)
        end = time.time()
        print(
            f"{name:34} {len(frame):8} rows  spark {middle - begin:6.2f}s  sql {end - middle:6.2f}s  "
            f"{problem or 'ok'}",
            flush=True,
        )
    print(f"{len(names) - failed} of {len(names)} equal")
    return 1 if failed else 0


if __name__ == "__main__":
    raise SystemExit(main())
