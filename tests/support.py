"""Helpers shared by the tests."""


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def by(df, *keys):
    """Rows as a dict by key column(s)."""
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r for r in df.collect()}
