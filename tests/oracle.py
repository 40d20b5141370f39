"""Compare queries with their SQL on one folder of tables: python tests/oracle.py FOLDER [NAME...]"""

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if pd.api.types.is_datetime64_any_dtype(df[c]) or df[c].map(lambda v: hasattr(v, "isoformat")).any():
            df[c] = pd.to_datetime(df[c]).astype("datetime64[ns]")
        elif pd.api.types.is_numeric_dtype(df[c]) and not pd.api.types.is_bool_dtype(df[c]):
            df[c] = df[c].astype(float).round(6) + 0.0
        else:
            df[c] = df[c].astype(object).where(df[c].notna(), None)
    return df.sort_values(list(df.columns), na_position="first", key=lambda s: s if s.dtype != object else s.astype(str)).reset_index(drop=True)


def difference(spark, con, folder, f, sql) -> str:
    got, want = canonical(f(spark, folder).toPandas()), canonical(con.execute(sql).df())
    if list(got.columns) != list(want.columns):
        return f"columns {list(got.columns)} and {list(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} and {len(want)}"
    if not len(got):
        return "no rows"
    try:
        pd.testing.assert_frame_equal(got, want, check_dtype=False, check_exact=False, rtol=1e-9, atol=2e-6)
    except AssertionError as e:
        return " ".join(str(e).split())[:400]
    return ""


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = SparkSession.builder.master("local[4]").config("spark.driver.memory", "4g").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    queries, oracles, con = entry.queries(), entry.oracle_sql(), connection(sys.argv[1])
    for name in sys.argv[2:] or oracles:
        began = time.time()
        try:
            said = difference(spark, con, sys.argv[1], queries[name], oracles[name])
        except Exception as e:  # noqa: BLE001
            said = f"{type(e).__name__}: {' '.join(str(e).split())[:500]}"
        print(f"{name}: {said or 'ok'} ({time.time() - began:.1f} s)", flush=True)
