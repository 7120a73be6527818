"""Rows of a DataFrame and of SQL, in one form and order."""


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, float):
        return round(v, 6)
    if hasattr(v, "item"):
        return v.item()
    if isinstance(v, bytearray | bytes):
        return bytes(v).hex()
    if isinstance(v, list | tuple) or hasattr(v, "tolist"):
        return tuple(plain(x) for x in v)
    return v


def rows_of(df):
    names = sorted(df.columns)
    return names, sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr)


def rows_of_sql(con, sql):
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted((tuple(plain(r[i]) for i in order) for r in got.fetchall()), key=repr)
