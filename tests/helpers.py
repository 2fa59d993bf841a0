"""Comparison of a query with its SQL."""

import glob
import os

import duckdb


def values(rows, columns):
    return sorted(repr(tuple(None if v != v else v for v in r)) for r in rows[columns].astype(object).itertuples(index=False, name=None))


def agree(spark, sf_dir, run, sql):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    ours, theirs = run(spark, sf_dir).toPandas(), con.execute(sql).fetchdf()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    clean = [d.astype(object).where(d.notna(), None) for d in (ours, theirs)]
    assert values(clean[0], columns) == values(clean[1], columns)
    return len(ours)
