"""Run queries beside their SQL and compare rows: ``python -m workload.compare [dir] [name ...]``.

``COMPARE_FOLDER`` names the folder for tables that queries store.
"""

from __future__ import annotations

import math
import os
import sys
import tempfile
import time
from collections import Counter

import duckdb
from pyspark.sql import SparkSession

from workload.oracles import ORACLES
from workload.queries import QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def session(cpus: int = 8, folder: str | None = None) -> SparkSession:
    """A local session. Tables that queries store go to ``folder``, else to a new temporary one,
    which this one machine shares with itself; a site's own ``spark.checkpoint.dir`` stays."""
    builder = SparkSession.builder
    if folder is not None or "spark.checkpoint.dir" not in os.environ.get("PYSPARK_SUBMIT_ARGS", ""):
        builder = builder.config("spark.checkpoint.dir", folder or tempfile.mkdtemp(prefix="thoughtlog-"))
    return (
        builder.master(f"local[{cpus}]")
        .appName("thoughtlog")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def _value(x: object) -> object:
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6) + 0.0
    return x


def _rows(names: list[str], rows: list[tuple]) -> Counter:
    order = sorted(range(len(names)), key=names.__getitem__)
    return Counter(tuple(_value(row[i]) for i in order) for row in rows)


def check(spark: SparkSession, con: duckdb.DuckDBPyConnection, sf_dir: str, name: str) -> str:
    start = time.time()
    df = QUERIES[name](spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    spark_sec = time.time() - start
    if name not in ORACLES:
        return f"rows only {len(got)} ({spark_sec:.1f}s)"
    start = time.time()
    con.execute(ORACLES[name])
    names = [d[0] for d in con.description]
    kinds = {d[0]: str(d[1]) for d in con.description}
    want = con.fetchall()
    sql_sec = time.time() - start
    if sorted(names) != sorted(df.columns):
        return f"COLUMNS {sorted(df.columns)} != {sorted(names)}"
    a, b = _rows(df.columns, got), _rows(names, want)
    if a != b:
        extra, missing = list((a - b).elements()), list((b - a).elements())
        return (
            f"DIFFERS {len(got)} vs {len(want)} rows; {len(extra)} extra, {len(missing)} missing\n"
            f"   spark {str(extra[:2])[:600]}\n   sql   {str(missing[:2])[:600]}"
        )
    hint = ""
    for field in df.schema:
        simple = field.dataType.simpleString()
        expected = {"bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE"}.get(simple, simple)
        if kinds[field.name] != expected:
            hint += f" [{field.name}: {simple} vs {kinds[field.name]}]"
    return f"ok {len(got)} rows (spark {spark_sec:.1f}s, sql {sql_sec:.1f}s){hint}"


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark, con = session(folder=os.environ.get("COMPARE_FOLDER")), database(sf_dir)
    spark.sparkContext.setLogLevel("ERROR")
    bad = 0
    for name in sys.argv[2:] or QUERIES:
        try:
            result = check(spark, con, sf_dir, name)
        except Exception as error:  # noqa: BLE001
            result = f"ERROR {type(error).__name__}: {str(error)[:1500]}"
        bad += not result.startswith(("ok", "rows only"))
        print(f"{name}: {result}", flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
