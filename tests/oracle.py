"""A query's rows against those of its SQL in DuckDB.

Run as a program it compares every registered query, or those named, on a folder of tables:
python tests/oracle.py FOLDER [NAME...]
"""

from __future__ import annotations

import datetime
import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(v: object) -> object:
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}") + 0.0
    if isinstance(v, (bytes, bytearray)):
        return bytes(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def differs(df, sql: str, c: duckdb.DuckDBPyConnection) -> str:
    """What is not equal, or nothing."""
    names = sorted(df.columns)
    mine = [tuple(map(plain, r)) for r in df.select(*[f"`{n}`" for n in names]).collect()]
    found = c.execute(sql)
    theirs_names = [d[0] for d in found.description]
    if sorted(theirs_names) != names:
        return f"columns {names} and {sorted(theirs_names)}"
    order = [theirs_names.index(n) for n in names]
    theirs = [tuple(plain(r[i]) for i in order) for r in found.fetchall()]
    key = lambda r: tuple((x is None, str(type(x)) if not isinstance(x, (int, float)) else "", x if x is not None else 0) for x in r)
    mine.sort(key=key)
    theirs.sort(key=key)
    if mine == theirs:
        return ""
    first = next(((a, b) for a, b in zip(mine, theirs) if a != b), None)
    return f"{len(mine)} and {len(theirs)} rows; {first}"


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    folder, wanted = sys.argv[1], sys.argv[2:]
    sql, bad = entry.oracle_sql(), 0
    for name, query in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        began = time.time()
        try:
            said = differs(query(spark, folder), sql[name], connection(folder)) if name in sql else f"rows only: {query(spark, folder).count()}"
        except Exception as e:  # noqa: BLE001
            said = f"{type(e).__name__}: {str(e)[:600]}"
        bad += bool(said) and not said.startswith("rows only")
        print(f"{'ok' if not said else said} | {name} | {time.time() - began:.1f}", flush=True)
    sys.exit(bool(bad))
