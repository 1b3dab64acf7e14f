import __spark_entry__ as entry_module


def test_contract(spark):
    queries, oracles = entry_module.queries(), entry_module.oracle_sql()
    assert set(oracles) <= set(queries) and all(callable(q) for q in queries.values())
    df = entry_module.entry(spark)
    assert df.columns == ["requests", "incomplete", "mean_tpot_ms", "median_tpot_ms", "p99_tpot_ms"]
    assert df.count() == 1
