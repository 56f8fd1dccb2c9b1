"""Equality of a query's rows with its oracle SQL's, as sets of values of columns in order of name."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    fine = lambda v: "-" if v is None else f"{v + 0.0:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(fine(r[i]) for i in order) for r in rows), sorted(names)


def compare(df, con, sql):
    got, names = plain([tuple(r) for r in df.collect()], df.columns)
    cur = con.execute(sql)
    want, other = plain(cur.fetchall(), [d[0] for d in cur.description])
    assert names == other, (names, other)
    assert len(got) == len(want), (len(got), len(want))
    wrong = [(a, b) for a, b in zip(got, want) if a != b]
    assert not wrong, (len(wrong), wrong[:3])
