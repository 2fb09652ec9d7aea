"""The training-data queries as the driver sees them."""


def test_registered_queries():
    import __spark_entry__ as e
    q, o = e.queries(), e.oracle_sql()
    mine = {k for k in q if k.startswith("op")} | {"pipeline"}
    assert {int(k[2:].split("_")[0]) for k in mine - {"pipeline"}} == set(range(1, 14))
    assert {k for k in mine if k in o} == {"op1_mix_sources", "op6_quotient_filter_dedup", "op11_best_position_search",
                                           "op13_suffix_decontamination"}
