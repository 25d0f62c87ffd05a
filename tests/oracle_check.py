"""Runs queries and their SQL side by side: ``python tests/oracle_check.py FOLDER [NAME...]``."""

import math
import sys
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


def connect(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in sorted(Path(folder).glob("*.parquet")):
        files = f"{path}/*.parquet" if path.is_dir() else str(path)
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{files}'")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted((tuple(_plain(r[k]) for k in order) for r in rows), key=repr)


def compare(spark, con, run, sql, folder):
    """None if equal, else what differs."""
    df = run(spark, folder)
    own_columns, own = rows_of(df.columns, [tuple(r) for r in df.collect()])
    found = con.execute(sql)
    its_columns, its = rows_of([c[0] for c in found.description], found.fetchall())
    if own_columns != its_columns:
        return f"columns {own_columns} and {its_columns}"
    if len(own) != len(its):
        return f"{len(own)} and {len(its)} rows"
    off = [(a, b) for a, b in zip(own, its) if repr(a) != repr(b)]
    return f"{len(off)} rows differ, such as {off[:3]}" if off else None


if __name__ == "__main__":
    import __spark_entry__ as entry
    from tallyforge.session import build_session

    spark = build_session("oracle", "local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="6g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sys.argv[1])
    queries, oracle = entry.queries(), entry.oracle_sql()
    for name in sys.argv[2:] or list(queries):
        if name not in oracle:
            print("no SQL", name)
            continue
        try:
            why = compare(spark, con, queries[name], oracle[name], sys.argv[1])
        except Exception as e:
            why = f"{type(e).__name__}: {str(e)[:400]}"
        print("ok  " if why is None else "FAIL", name, (why or "")[:700], flush=True)
