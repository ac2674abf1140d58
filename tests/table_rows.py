"""Helpers of the tests, in a module whose name no other folder has."""


def rows(df, *cols):
    """Collected rows as sorted tuples."""
    return sorted([tuple(r[c] for c in cols) for r in df.collect()], key=lambda t: tuple((x is None, x) for x in t))
