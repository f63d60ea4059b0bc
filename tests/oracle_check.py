"""Compare catalog queries with their SQL: ``python tests/oracle_check.py [folder] [names...]``."""

import glob
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


TIMES: dict[str, float] = {}


def cell(value):
    if value is None or value is pd.NaT:
        return None
    if isinstance(value, float):
        return None if value != value else repr(float(value))
    if isinstance(value, pd.Timestamp):
        return value.isoformat()
    if hasattr(value, "item"):
        return cell(value.item())
    return str(value)


def rows_of(frame: pd.DataFrame) -> tuple[list[str], list[tuple]]:
    names = sorted(frame.columns)
    out = []
    for c in names:
        values = frame[c]
        if str(values.dtype).startswith("datetime"):
            values = values.astype("datetime64[us]")
        # whole numbers compare equal whatever their width, and also as doubles
        if pd.api.types.is_integer_dtype(values) and not pd.api.types.is_bool_dtype(values):
            out.append([str(v) for v in values])
        else:
            out.append([cell(v) for v in values])
    return names, sorted(zip(*out), key=lambda r: tuple("" if v is None else v for v in r))


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def differences(spark, con, folder: str, name: str, query, sql: str | None) -> str | None:
    start = time.time()
    got = query(spark, folder).toPandas()
    TIMES[name] = time.time() - start
    if sql is None:
        return None if len(got) else "no rows"
    want = con.execute(sql).fetchdf()
    got_names, got_rows = rows_of(got)
    want_names, want_rows = rows_of(want)
    if got_names != want_names:
        return f"columns {got_names} != {want_names}"
    if len(got_rows) != len(want_rows):
        return f"{len(got_rows)} rows != {len(want_rows)}"
    wrong = [(g, w) for g, w in zip(got_rows, want_rows) if g != w]
    if wrong:
        return f"{len(wrong)} of {len(got_rows)} rows differ, first {got_names}\n  got  {wrong[0][0]}\n  want {wrong[0][1]}"
    kinds = [(c, str(got[c].dtype), str(want[c].dtype)) for c in got_names
             if got[c].dtype.kind != want[c].dtype.kind]
    return f"types {kinds}" if kinds else None


if __name__ == "__main__":
    import __spark_entry__ as entry
    from ledgerlynx.session import build_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(entry.queries())
    spark = build_session(master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
        "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    failed = []
    for name in names:
        start = time.time()
        try:
            problem = differences(
                spark, con, folder, name, entry.queries()[name], entry.oracle_sql().get(name))
        except Exception as e:  # report every query
            problem = f"{type(e).__name__}: {str(e)[:1500]}"
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {TIMES.get(name, 0):.2f}s of {time.time() - start:.2f}s",
              "" if problem is None else problem, flush=True)
        if problem is not None:
            failed.append(name)
    print("failed:", failed)
