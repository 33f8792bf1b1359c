"""Shared by all tests."""

import math
import os

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    """A value that rows of both engines have alike."""
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def same_rows(df, relation):
    names, rows = [d[0] for d in relation.description], relation.fetchall()
    assert sorted(df.columns) == sorted(names)
    cols = sorted(names)
    a = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    b = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in rows), key=repr)
    assert a == b
