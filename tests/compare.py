"""Spark rows against DuckDB rows, in any order."""


def rows_of(df):
    return sorted([tuple(map(repr, (r[c] for c in sorted(df.columns)))) for r in df.collect()])


def sql_rows(con, sql):
    cur = con.execute(sql)
    names = [x[0] for x in cur.description]
    order = [names.index(c) for c in sorted(names)]
    return sorted(names), sorted(tuple(repr(r[i]) for i in order) for r in cur.fetchall())


def assert_same(df, con, sql):
    names, want = sql_rows(con, sql)
    assert sorted(df.columns) == names
    assert rows_of(df) == want
