"""Compare a query's rows with DuckDB's, column by name and row order aside."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _cell(x):
    if x is None:
        return (0, "")
    if isinstance(x, bool):
        return (1, int(x))
    if isinstance(x, float) and not math.isnan(x):
        return (1, round(x, 6) + 0.0)
    if isinstance(x, int):
        return (1, round(float(x), 6))
    return (2, str(x))


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def _connected(folder):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def n_rows(sql, folder):
    return len(_connected(folder).execute(sql).fetchall())


def differences(df, sql, folder):
    """None where both agree, else a short account."""
    result = _connected(folder).execute(sql)
    names = [c[0] for c in result.description]
    want = _rows(names, result.fetchall())
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if got == want:
        return None
    only = [x for x in got if x not in set(want)][:2], [x for x in want if x not in set(got)][:2]
    return f"{len(got)} and {len(want)} rows; only here {only[0]}; only there {only[1]}"
