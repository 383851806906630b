"""Helpers of the tests."""


def rows(df, *columns):
    """The rows as tuples in a settled order."""
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=lambda r: tuple((v is not None, str(v)) for v in r))
