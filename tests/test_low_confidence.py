"""The report of low confidence has the least confident values too."""

from finquill.plans.catalogue import Q


def test_low_confidence_has_no_lower_bound(spark):
    found = {round(r.confidence, 1) for r in Q["low_confidence"](spark, "/root/testdata/sf0.001").select("confidence").distinct().collect()}
    assert max(found) < 0.75 and min(found) <= 0.4
