import __spark_entry__ as entry


def test_catalogue():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 60 and all(callable(q) for q in queries.values())


def test_every_core_query_runs(spark):
    from gradewright.plans import catalogue

    for name, query in catalogue.QUERIES.items():
        df = query(spark, "/root/testdata/sf0.001")
        assert df.columns and len(df.columns) == len(set(df.columns)), name
        df.limit(3).collect()


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
