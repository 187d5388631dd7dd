"""Order-insensitive comparison of small results."""


def rows(df, *cols):
    """Sorted list of tuples."""
    cols = cols or df.columns
    return sorted([tuple(r[c] for c in cols) for r in df.collect()],
                  key=lambda t: tuple((x is None, str(x)) for x in t))
