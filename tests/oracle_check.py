"""Run every query beside its SQL counterpart: python tests/oracle_check.py SF_DIR [names...]"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings"
    " pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    return value


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(
        ([_plain(r[i]) for i in order] for r in rows), key=lambda r: [(v is None, str(v)) for v in r]
    )


def compare(spark, con, name, query, sql, sf_dir):
    """None when equal, else a short description of the first difference."""
    df = query(spark, sf_dir)
    ours = normal(df.columns, df.collect())
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    theirs = normal(columns, result.fetchall())
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    if len(ours) != len(theirs):
        return f"{len(ours)} rows != {len(theirs)}"
    for a, b in zip(ours, theirs):
        if a != b:
            return f"{str(a)[:700]}\n   != {str(b)[:700]}"
    return None


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as contract

    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    folder, wanted = sys.argv[1], sys.argv[2:]
    duck = connect(folder)
    oracles = contract.oracle_sql()
    for key, fn in contract.queries().items():
        if wanted and key not in wanted:
            continue
        start = time.time()
        try:
            if key in oracles:
                verdict = compare(session, duck, key, fn, oracles[key], folder) or "equal"
            else:
                verdict = f"rows only: {fn(session, folder).count()}"
        except Exception as e:  # noqa: BLE001
            verdict = f"FAILED {type(e).__name__}: {str(e)[:600]}"
        print(f"{key:26s} {time.time() - start:6.2f}s  {verdict}", flush=True)
