import __spark_entry__ as entry_module


def test_registered_names_are_unique_and_sql_has_a_query():
    names = entry_module.queries()
    assert set(entry_module.oracle_sql()) <= set(names)
