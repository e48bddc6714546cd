"""Run registered queries against their oracles: ``python tests/compare.py [sf_dir] [name ...]``."""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels"
          " conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return connection


def canonical(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)].copy()
    for name in frame.columns:
        if pd.api.types.is_numeric_dtype(frame[name]):
            frame[name] = frame[name].astype("float64").round(6) + 0.0
        else:
            frame[name] = frame[name].where(frame[name].notna(), None).astype(object)
    return frame.sort_values(list(frame.columns), na_position="first").reset_index(drop=True)


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    """None if both hold the same rows, else a description."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} vs {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    got, want = canonical(got), canonical(want)
    for name in got.columns:
        a, b = got[name], want[name]
        equal = (a == b) | (a.isna() & b.isna())
        if not equal.all():
            at = (~equal).idxmax()
            return f"{(~equal).sum()} values of {name}, e.g. {got.loc[at].to_dict()} vs {want.loc[at].to_dict()}"
    return None


def main() -> None:
    import __spark_entry__ as entry
    from tests.conftest import make_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(entry.queries())
    spark, connection, sql = make_session(), connect(sf_dir), entry.oracle_sql()
    bad = 0
    for name in names:
        started = time.time()
        try:
            got = entry.queries()[name](spark, sf_dir).toPandas()
            problem = difference(got, connection.execute(sql[name]).fetchdf())
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {name} {time.time() - started:.1f}s {problem or ''}", flush=True)
    print(f"{len(names) - bad} of {len(names)} match")


if __name__ == "__main__":
    main()
