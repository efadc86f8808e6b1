import __spark_entry__ as entry


def test_registered_queries():
    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names)
    assert {"tets6", "tree_nodes", "iso_leaves"} <= set(names)
