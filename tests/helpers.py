"""What several test modules compare with."""


def same(a, b):
    """Both frames hold the same rows."""
    b = b.select(*a.columns)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
