"""The driver's contract."""

import __spark_entry__ as entry


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and {r["status"] for r in rows} <= {"OK", "NEEDS_INFO", "FAIL"}


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert all(callable(f) for f in entry.queries().values())
