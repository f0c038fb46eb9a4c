"""Order-free comparison of a Spark result with a DuckDB result."""

import math


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(v):
        if isinstance(v, float):
            return None if math.isnan(v) else v + 0.0
        return v

    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def same(df, duck, sql):
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = duck.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows_of(names, cur.fetchall())
    assert sorted(df.columns) == sorted(names)
    assert got == want
