import __spark_entry__ as entry


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_gives_three_outcomes(spark):
    assert {r.outcome for r in entry.entry(spark).collect()} <= {"exact", "unmatched", "ambiguous"}
