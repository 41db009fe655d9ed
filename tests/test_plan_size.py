from winnow import plans


def test_the_search_for_leftovers_does_not_hold_the_redaction_again(spark, sf_dir):
    left = plans.QUERIES["redaction_leftovers"](spark, sf_dir)
    assert left._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") < 100
    assert left.filter("n_left <> 0").count() == 0
