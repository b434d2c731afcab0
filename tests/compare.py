"""Run queries against their SQL forms and report differences.

    python tests/compare.py [folder] [query ...]
"""

import contextlib
import io
import sys
import time

import duckdb

sys.path.insert(0, __file__.rsplit("/", 2)[0])

from __spark_entry__ import oracle_sql, queries  # noqa: E402
from defectlab.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
KINDS = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
}


def database(folder):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def difference(df, con, sql):
    """None when both sides agree, else what differs."""
    names = sorted(df.columns)
    rows = sorted(map(repr, (tuple(r) for r in df.select(*[f"`{n}`" for n in names]).collect())))
    found = con.execute(sql)
    kinds = {d[0]: str(d[1]) for d in found.description}
    if sorted(kinds) != names:
        return f"columns {names} against {sorted(kinds)}"
    wrong = [(f.name, f.dataType.simpleString(), kinds[f.name]) for f in df.schema if KINDS[f.dataType.simpleString()] != kinds[f.name]]
    order = [[d[0] for d in found.description].index(n) for n in names]
    other = sorted(repr(tuple(r[i] for i in order)) for r in found.fetchall())
    if len(rows) != len(other):
        return f"{len(rows)} rows against {len(other)}"
    for a, b in zip(rows, other):
        if a != b:
            return f"{a} against {b}"
    return f"types {wrong}" if wrong else None


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def main():
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    made, sql = queries(), oracle_sql()
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = database(folder)
    for name in sys.argv[2:] or made:
        start = time.time()
        try:
            df = made[name](spark, folder)
            if name in sql:
                problem = difference(df, con, sql[name])
                verdict = "same" if problem is None else f"DIFFERS: {problem[:600]}"
            else:
                verdict = f"{len(df.collect())} rows, no SQL"
        except Exception as error:
            verdict = f"FAILS: {type(error).__name__} {str(error)[:700]}"
        print(f"{name:28s} {time.time() - start:6.2f}s  {verdict}", flush=True)


if __name__ == "__main__":
    main()
