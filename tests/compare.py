"""Run queries and their SQL side by side: ``python tests/compare.py sf_dir [query ...]``."""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def tables(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET max_temp_directory_size = '4GB'")
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        kind = df[c].dtype.kind
        if kind in "iu" and df[c].isna().any():
            df[c] = df[c].astype("Int64").astype(object)
        elif kind in "iu":
            df[c] = df[c].astype("int64")
        elif kind == "f" and df[c].isna().any() and (df[c].dropna() % 1 == 0).all():
            df[c] = df[c].astype("Int64").astype(object)
        elif kind == "O" or kind not in "fb":
            df[c] = df[c].astype(object)
    return df.sort_values(list(df.columns), key=lambda s: s.astype(str)).reset_index(drop=True)


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} / {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} / {len(want)}"
    got, want = canonical(got), canonical(want)
    for c in got.columns:
        unequal = (got[c].astype(str) != want[c].astype(str)).to_numpy()
        if unequal.any():
            i = unequal.argmax()
            return f"column {c}, {unequal.sum()} rows: {got.iloc[i].to_dict()} / {want.iloc[i].to_dict()}"
    return None


def main(sf_dir: str, names: list[str]) -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.driver.memory", "12g")
        .config("spark.driver.maxResultSize", "4g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, failed = tables(sf_dir), 0
    queries, sql = e.queries(), e.oracle_sql()
    for name in names or list(queries):
        try:
            t0 = time.time()
            got = queries[name](spark, sf_dir).toPandas()
            t1 = time.time()
            if name not in sql:
                print(f"{name}: {len(got)} rows, no SQL, {t1 - t0:.1f}s", flush=True)
                continue
            want = con.execute(sql[name]).df()
            t2 = time.time()
            diff = difference(got, want)
        except Exception as x:  # report and go on with the next query
            diff, t1, t2, got = f"{type(x).__name__}: {str(x)[:1500]}", t0, t0, []
        failed += diff is not None
        print(f"{name}: {'ok' if diff is None else 'DIFF ' + diff} rows={len(got)} spark={t1 - t0:.1f}s sql={t2 - t1:.1f}s", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
