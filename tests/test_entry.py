import __spark_entry__ as E


def test_entry_runs(spark):
    rows = E.entry(spark).collect()
    assert len(rows) == 11 and rows[0]["column"] == "l_orderkey"


def test_every_oracle_has_a_query():
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    extra = set(E.LLM.queries()) | {"pipeline"} if E.LLM else set()
    assert set(qs) - set(sql) <= extra
