"""Rows of DataFrames in a comparable form."""


def table(df, *cols):
    """Rows as a sorted list, doubles shortened."""
    names = cols or df.columns
    out = [
        tuple(round(v, 9) if isinstance(v, float) else v for v in row)
        for row in df.select(*names).collect()
    ]
    return sorted(out, key=str)
