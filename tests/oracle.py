"""Rows of a query and of its SQL in a comparable form."""

import duckdb

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(columns, records):
    fix = lambda v: round(v, 6) if isinstance(v, float) else v
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(str(tuple(fix(r[i]) for i in order)) for r in records)


def of_sql(sql, sf_dir=SMALL):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    out = c.execute(sql)
    return rows([d[0] for d in out.description], out.fetchall())


def of_frame(df):
    return rows(df.columns, [tuple(r) for r in df.collect()])
