"""Compare a registered query with its SQL: columns, types, and all rows.

Run as a script: python tests/compare.py [folder of tables] [query ...]
"""

import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from gradeweave.registry.oracle import ORACLE  # noqa: E402
from gradeweave.registry.queries import QUERIES  # noqa: E402

TABLES = ("orders", "customer", "lineitem")
SAME_TYPE = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def spark_type(field):
    name = field.dataType.simpleString()
    return SAME_TYPE.get(name, name.upper())


def differences(con, spark, sf_dir, name):
    """Empty when equal."""
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = Counter(tuple(r) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    rel = con.cursor().execute(ORACLE[name])
    heads = [d[0] for d in rel.description]
    types = {d[0]: str(d[1]).replace(" ", "") for d in rel.description}
    rows = rel.fetchall()
    if sorted(heads) != columns:
        return [f"columns {columns} against {sorted(heads)}"], 0
    pick = [heads.index(c) for c in columns]
    want = Counter(tuple(r[i] for i in pick) for r in rows)
    out = []
    for f in df.schema.fields:
        if spark_type(f) != types[f.name]:
            out.append(f"type of {f.name}: {spark_type(f)} against {types[f.name]}")
    extra, missing = got - want, want - got
    if extra or missing:
        out.append(f"{sum(extra.values())} rows only in Spark, {sum(missing.values())} only in SQL")
        out += [f"  spark {r}" for r in list(extra)[:3]] + [f"  sql   {r}" for r in list(missing)[:3]]
    return out, sum(got.values())


if __name__ == "__main__":
    from gradeweave.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:] or sorted(ORACLE)
    session = local_session("8")
    session.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for q in wanted:
        start = time.time()
        try:
            found, n = differences(con, session, folder, q)
        except Exception as e:  # report and go on with the other queries
            found, n = [f"{type(e).__name__}: {str(e)[:1500]}"], 0
        bad += bool(found)
        print(f"{'FAIL' if found else 'ok  '} {q:28s} {n:8d} rows {time.time() - start:6.1f}s", flush=True)
        for line in found:
            print("     ", line, flush=True)
    print("failed:", bad)
