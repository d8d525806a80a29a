"""Side-by-side run of a registered query and its SQL, compared exactly as sets of rows."""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, REPO)

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def _canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def differences(got: pd.DataFrame, want: pd.DataFrame) -> list[str]:
    if sorted(got.columns) != sorted(want.columns):
        return [f"columns {sorted(got.columns)} != {sorted(want.columns)}"]
    if len(got) != len(want):
        return [f"rows {len(got)} != {len(want)}"]
    got, want = _canonical(got), _canonical(want)
    found = []
    for column in got.columns:
        a, b = got[column], want[column]
        kinds = (a.dtype.kind, b.dtype.kind)
        if kinds[0] != kinds[1] and not set(kinds) <= set("OTU"):
            found.append(f"{column}: dtype {a.dtype} != {b.dtype}")
        unequal = ~((a == b) | (a.isna() & b.isna()))
        if unequal.any():
            i = unequal.idxmax()
            found.append(f"{column}: {unequal.sum()} values differ, e.g. {a[i]!r} != {b[i]!r}")
    return found


def main(sf_dir: str, names: list[str]) -> None:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sql = connect(sf_dir), entry.oracle_sql()
    for name, run in entry.queries().items():
        if names and name not in names:
            continue
        try:
            start = time.time()
            got = run(spark, sf_dir).toPandas()
            seconds = time.time() - start
            start = time.time()
            want = con.execute(sql[name]).df() if name in sql else None
            sql_seconds = time.time() - start
            found = ["rows only"] if want is None else differences(got, want)
            print(f"{name:28s} {len(got):7d} rows {seconds:6.2f} s (sql {sql_seconds:5.2f} s) {found or 'ok'}")
        except Exception as error:  # report and go on
            print(f"{name:28s} FAILED {type(error).__name__}: {str(error)[:300]}")


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
