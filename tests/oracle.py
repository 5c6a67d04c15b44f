"""Run a query and its oracle on the given tables and compare rows as multisets."""

import glob
import os
from collections import Counter

import duckdb
import numpy as np

DATA = "/root/testdata/sf0.001"


def connect():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def canonical(v):
    if v is None or v is np.nan or (isinstance(v, float) and v != v) or str(v) in ("<NA>", "NaT"):
        return None
    if isinstance(v, (float, np.floating)):
        return round(float(v), 9)
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (int, np.integer)):
        return int(v)
    if hasattr(v, "__len__") and not isinstance(v, (str, bytes)):
        return tuple(canonical(x) for x in v)
    return v


def rows(frame):
    columns = sorted(frame.columns)
    # whole numbers beside nulls arrive as floats on one side
    fix = lambda v: int(v) if isinstance(v, float) and v == int(v) else v
    return columns, Counter(tuple(fix(canonical(v)) for v in r) for r in frame[columns].astype(object).itertuples(index=False))


def same(spark, con, query, sql) -> None:
    got, want = rows(query(spark, DATA).toPandas()), rows(con.execute(sql).fetchdf())
    assert got[0] == want[0]
    assert got[1] == want[1], (list((got[1] - want[1]).items())[:3], list((want[1] - got[1]).items())[:3])
