"""Compare queries with their SQL twins: `python -m workload.check [sf_dir] [name-prefix ...]`."""

from __future__ import annotations

import math
import sys
import time

from workload.shapes import TABLES


def _cell(value):
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else repr(value)
    return str(value)


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE"}


def compare(df, con, sql: str) -> str:
    """Empty when columns, types and rows agree, else what differs."""
    got = con.execute(sql)
    types = {c[0]: str(c[1]) for c in got.description}
    names = sorted(types)
    if sorted(df.columns) != names:
        return f"columns {sorted(df.columns)} vs {names}"
    wrong = {f.name: (f.dataType.simpleString(), types[f.name]) for f in df.schema if KINDS.get(f.dataType.simpleString()) != types[f.name]}
    if wrong:
        return f"types {wrong}"
    order = [c[0] for c in got.description]
    want = sorted(tuple(_cell(dict(zip(order, r))[n]) for n in names) for r in got.fetchall())
    have = sorted(tuple(_cell(r[n]) for n in names) for r in df.collect())
    if have == want:
        return ""
    only_have, only_want = sorted(set(have) - set(want)), sorted(set(want) - set(have))
    return f"{len(have)} vs {len(want)} rows; {names} spark only {only_have[:2]}; sql only {only_want[:2]}"


def main(argv: list[str]) -> int:
    from cidrloom.session import local_session
    from workload import ORACLES, QUERIES

    sf_dir = argv[0] if argv else "/root/testdata/sf0.001"
    spark = local_session(8, "check")
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = duck(sf_dir), 0
    for name, fn in QUERIES.items():
        if argv[1:] and not any(name.startswith(p) for p in argv[1:]):
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in ORACLES:
                problem = compare(df, con, ORACLES[name])
                rows = con.execute(f"SELECT count(*) FROM ({ORACLES[name]})").fetchone()[0]
            else:
                rows, problem = df.count(), ""
        except Exception as err:  # noqa: BLE001 - report and go on
            rows, problem = -1, f"{type(err).__name__}: {str(err)[:700]}"
        bad += bool(problem)
        print(f"{'FAIL' if problem else 'ok'} {name} rows={rows} {time.time() - start:.1f}s {'' if name in ORACLES else '(rows only)'} {problem}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
