"""Side-by-side comparison of a Spark query and its SQL over the same Parquet tables."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def _norm(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r))


def compare(spark, con, query, sf_dir: str) -> tuple[list[str], int]:
    """Differences (columns, types, rows) and the number of rows."""
    df = query.run(spark, sf_dir)
    got = _rows(df.columns, df.collect())
    rel = con.sql(query.sql)
    want = _rows(rel.columns, rel.fetchall())
    problems = []
    if sorted(df.columns) != sorted(rel.columns):
        problems.append(f"columns {sorted(df.columns)} != {sorted(rel.columns)}")
    kinds = {"INTEGER": "int", "BIGINT": "bigint", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}
    types = dict(df.dtypes)
    for name, kind in zip(rel.columns, rel.types):
        if types.get(name) != kinds.get(str(kind), str(kind)):
            problems.append(f"type of {name}: {types.get(name)} != {kind}")
    if len(got) != len(want):
        problems.append(f"rows {len(got)} != {len(want)}")
    if got != want:
        diff = [(a, b) for a, b in zip(got, want) if a != b]
        problems.append(f"{len(diff)} differing rows, first: {str(diff[0])[:600] if diff else ''}")
    return problems, len(got)


if __name__ == "__main__":
    from catalogloom.driver.registry import ALL
    from catalogloom.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    chosen = sys.argv[2:] or list(ALL)
    session = local_session(8)
    session.sparkContext.setLogLevel("ERROR")
    link = connect(folder)
    bad = 0
    for key in chosen:
        start = time.time()
        try:
            found, count = compare(session, link, ALL[key], folder)
        except Exception as error:  # report and go on
            found, count = [f"{type(error).__name__}: {str(error)[:1500]}"], -1
        bad += bool(found)
        print(f"{'FAIL' if found else 'ok  '} {key} rows={count} {time.time() - start:.2f}s", *found, sep="\n     " if found else " ", flush=True)
    print("failed:", bad, "of", len(chosen))
