"""How often exports are read."""

from citeflow.plans import queries


def test_exports_are_read_once(spark, sf_dir):
    got = queries.csl_exports(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "get_json_object" not in got and got.count("from_json") == 1
