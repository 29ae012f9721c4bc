"""What several test modules use."""

import os

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def same_rows(df, connection, sql):
    """Asserts that a frame and a query give the same rows and names."""
    columns = sorted(df.columns)
    mine = sorted(repr(tuple(r)) for r in df.select(*columns).collect())
    theirs = sorted(repr(tuple(r)) for r in connection.execute(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall())
    assert len(mine) == len(theirs)
    assert mine == theirs
