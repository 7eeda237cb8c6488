"""Comparison of Spark rows with a DuckDB cursor."""


def plain(x):
    if x is None or x != x:
        return None
    if isinstance(x, float):
        return round(x, 9)
    return x


def same(spark_rows, spark_columns, cursor) -> None:
    """Rows equal those of a DuckDB cursor, whatever the order of rows and columns."""
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(spark_columns)
    got = sorted((tuple(plain(r[c]) for c in sorted(names)) for r in spark_rows), key=repr)
    want = sorted((tuple(plain(dict(zip(names, r, strict=True))[c]) for c in sorted(names)) for r in cursor.fetchall()), key=repr)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert all(x == y or (isinstance(x, (int, float)) and isinstance(y, (int, float)) and float(x) == float(y)) for x, y in zip(a, b, strict=True)), (a, b)
