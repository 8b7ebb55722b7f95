"""Side-by-side comparison of a query with its SQL."""

import math

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
TYPES = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean"}


def connect(folder):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    return repr(v)


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple(cell(r[c]) for c in cols) for r in df.collect()), dict(df.dtypes)


def sql_rows(con, sql):
    r = con.execute(sql)
    names, types = [d[0] for d in r.description], {d[0]: str(d[1]) for d in r.description}
    order = sorted(range(len(names)), key=lambda i: names[i])
    rows = sorted(tuple(cell(x[i]) for i in order) for x in r.fetchall())
    return sorted(names), rows, {n: TYPES.get(t, t) for n, t in types.items()}
