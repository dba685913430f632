"""Runs catalogue queries beside their SQL oracle and compares the rows."""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events".split()


def oracle_connection(root: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{root}/{name}.parquet'")
    return con


def _plain(column: pd.Series) -> pd.Series:
    """Numbers as floats, everything else as text, missing values as one mark."""
    if pd.api.types.is_bool_dtype(column) or column.dropna().map(type).eq(bool).all() and len(column.dropna()):
        return column.map({True: "true", False: "false"}).fillna("-")
    if pd.api.types.is_numeric_dtype(column):
        return column.astype("Float64").astype("float64")
    if pd.api.types.is_datetime64_any_dtype(column) or column.dropna().map(lambda v: hasattr(v, "isoformat")).all():
        return pd.to_datetime(column).astype("datetime64[us]").astype(str)
    return column.astype(str)


def plain(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)]
    out = pd.DataFrame({c: _plain(frame[c]) for c in frame.columns})
    return out.sort_values(list(out.columns)).reset_index(drop=True)


def differences(spark_frame: pd.DataFrame, oracle_frame: pd.DataFrame) -> list[str]:
    if sorted(spark_frame.columns) != sorted(oracle_frame.columns):
        return [f"columns {sorted(spark_frame.columns)} / {sorted(oracle_frame.columns)}"]
    left, right = plain(spark_frame), plain(oracle_frame)
    if len(left) != len(right):
        both = left.merge(right, how="outer", indicator=True)
        odd = both[both["_merge"] != "both"].head(4)
        return [f"rows {len(left)} / {len(right)}", *map(str, odd.to_dict("records"))]
    out = []
    for c in left.columns:
        if left[c].dtype != right[c].dtype:
            if left[c].isna().all() and right[c].astype(str).isin(["None", "nan", "NaT", "-"]).all():
                continue
            out.append(f"{c}: {left[c].dtype} / {right[c].dtype}")
            continue
        same = (left[c] == right[c]) | (left[c].isna() & right[c].isna())
        if not same.all():
            at = same.idxmin()
            out.append(f"{c}: {int((~same).sum())} differ, first {left[c][at]!r} / {right[c][at]!r}")
    return out


if __name__ == "__main__":
    from tidebook.plans.catalogue import ORACLE, QUERIES
    from tidebook.session import build_session

    root = sys.argv[1]
    names = sys.argv[2:] or list(QUERIES)
    spark = build_session(
        "local[8]",
        shuffle_partitions=8,
        extra_conf={"spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle_connection(root)
    good = 0
    for name in names:
        start = time.time()
        try:
            left = QUERIES[name](spark, root).toPandas()
            took = time.time() - start
            if name not in ORACLE:
                print(f"ROWS {name} {len(left)} {took:.1f}s", flush=True)
                continue
            start = time.time()
            right = con.execute(ORACLE[name]).df()
            diff = differences(left, right)
        except Exception as error:  # noqa: BLE001
            print(f"ERROR {name}: {str(error)[:900]}", flush=True)
            continue
        good += not diff
        print(("OK   " if not diff else "DIFF ") + f"{name} {len(left)} rows {took:.1f}s oracle {time.time() - start:.1f}s", flush=True)
        for line in diff:
            print("     ", line[:700])
    print(good, "of", len(names))
