"""Hold queries against their SQL twins: same columns, same rows in any order."""

import math
from pathlib import Path

import duckdb


def views(sf_dir):
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, list | tuple):
        return [plain(x) for x in v]
    return v if v is None or isinstance(v, bool) else str(v)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted((str([plain(r[k]) for k in order]) for r in rows))


def compare(df, con, sql):
    """None if they agree, else what differs."""
    rel = con.sql(sql)
    got, want = table(df.columns, df.collect()), table(rel.columns, rel.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} and {want[0]}"
    if got[1] != want[1]:
        a, b = [x for x in got[1] if x not in set(want[1])][:3], [x for x in want[1] if x not in set(got[1])][:3]
        return f"{len(got[1])} and {len(want[1])} rows; here {a}; SQL {b}"
    return None
