"""What tests share."""

import os

SMALL = "/root/testdata/sf0.001"


def as_rows(frame):
    """Rows of a pandas frame as sorted tuples of text, columns by name, floats rounded."""
    columns = sorted(frame.columns)

    def cell(v):
        if v is None or v != v:
            return "null"
        if isinstance(v, bool) or type(v).__name__ in ("bool", "bool_"):
            return str(bool(v))
        if isinstance(v, float) and v == int(v):
            return str(int(v))
        return f"{v:.9g}" if isinstance(v, float) else str(v)

    values = frame[columns].astype(object).where(frame[columns].notna(), None).values.tolist()
    return columns, sorted(tuple(cell(v) for v in row) for row in values)


def duck(base):
    import glob

    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{base}/*.parquet"):
        files = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{files}')")
    return con
