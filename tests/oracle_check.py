"""Compare catalogue queries with their SQL: python tests/oracle_check.py [sf_dir] [name...]"""

import sys
import time

import duckdb
import pandas as pd


def frames_equal(got: pd.DataFrame, want: pd.DataFrame) -> str:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    cols = sorted(got.columns)

    def canon(df):
        out = df[cols].copy()
        for c in cols:
            if out[c].dtype.kind in "if":
                out[c] = out[c].astype(float) + 0.0
            else:
                out[c] = out[c].astype(str)
        return out.sort_values(cols, na_position="first").reset_index(drop=True)

    a, b = canon(got), canon(want)
    for c in cols:
        if a[c].dtype != b[c].dtype:
            return f"{c}: {got[c].dtype} != {want[c].dtype}"
        same = (a[c] == b[c]) | (a[c].isna() & b[c].isna())
        if not same.all():
            i = same.idxmin()
            return f"{c} differs in {(~same).sum()} rows, e.g. {a.loc[i].to_dict()} != {b.loc[i].to_dict()}"
    return ""


def tables(con, d):
    for t in (
        "region nation customer supplier part orders lineitem events documents embeddings pages "
        "benchmark labels conversations"
    ).split():
        con.execute(f"create view {t} as select * from read_parquet('{d}/{t}.parquet')")


if __name__ == "__main__":
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as entry
    from tests.conftest import make_session

    d = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark = make_session()
    con = duckdb.connect()
    tables(con, d)
    sql = entry.oracle_sql()
    bad = []
    for name, run in entry.queries().items():
        if names and name not in names:
            continue
        t = time.time()
        try:
            got = run(spark, d).toPandas()
            took = time.time() - t
            if name not in sql:
                print(f"{name:28s} rows={len(got)} no sql  {took:.2f}s", flush=True)
                continue
            message = frames_equal(got, con.execute(sql[name]).df())
        except Exception as e:  # noqa: BLE001
            took = time.time() - t
            message = f"{type(e).__name__}: {str(e)[:600]}"
        if message:
            bad.append(name)
        print(f"{name:28s} {'OK' if not message else 'FAIL ' + message}  {took:.2f}s", flush=True)
    print("failed:", bad)
