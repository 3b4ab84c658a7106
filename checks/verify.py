"""Runs registered queries against their DuckDB twins: python -m checks.verify [sf_dir] [name ...]"""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb
import pandas as pd

from checks.catalog import ORACLES, QUERIES
from widesift.session import build_session

KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def canonical(frame: pd.DataFrame, whole: list[str]) -> pd.DataFrame:
    """All values as text, rows in order; `whole` names the columns of whole numbers, which pandas keeps as floats beside nulls."""
    columns = sorted(frame.columns)
    text = frame[columns].astype({c: "Int64" for c in whole}).astype(object)
    text = text.apply(lambda c: c.map(lambda v: "null" if v is None or v is pd.NA or v != v else repr(float(v)) if isinstance(v, float) else str(v)))
    return text.sort_values(columns).reset_index(drop=True)


def compare(spark, con, sf_dir: str, name: str) -> str:
    started = time.time()
    df = QUERIES[name](spark, sf_dir)
    got = df.toPandas()
    spent = time.time() - started
    if name not in ORACLES:
        return f"rows={len(got)} (no twin) {spent:.2f}s"
    started = time.time()
    relation = con.execute(ORACLES[name])
    want_types = {d[0]: str(d[1]) for d in relation.description}
    want = relation.df()
    oracle = time.time() - started
    tail = f"rows={len(got)} spark={spent:.2f}s duckdb={oracle:.2f}s"
    got_types = {f.name: KINDS.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema.fields}
    if set(got_types) != set(want_types):
        return f"FAIL columns {sorted(got_types)} != {sorted(want_types)} {tail}"
    if got_types != want_types:
        return f"FAIL types { {k: (got_types[k], want_types[k]) for k in got_types if got_types[k] != want_types[k]} } {tail}"
    if len(got) != len(want):
        return f"FAIL rows {len(got)} != {len(want)} {tail}"
    whole = [c for c, kind in want_types.items() if kind in ("BIGINT", "INTEGER")]
    a, b = canonical(got, whole), canonical(want, whole)
    if not a.equals(b):
        bad = (a != b).any(axis=1)
        return f"FAIL {int(bad.sum())} rows differ, e.g.\n{a[bad].head(3)}\n{b[bad].head(3)} {tail}"
    return f"ok {tail}"


def main() -> None:
    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark = build_session("verify", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failures = 0
    for name in args or list(QUERIES):
        try:
            result = compare(spark, con, sf_dir, name)
        except Exception as error:  # report and go on with the next query
            result = f"FAIL {type(error).__name__}: {str(error)[:1500]}"
        failures += result.startswith("FAIL")
        print(f"{name}: {result}", flush=True)
    print(f"{failures} failures")
    sys.exit(bool(failures))


if __name__ == "__main__":
    main()
