"""The queries by day leave no visit out."""

import os

from pyspark.sql import functions as F

from visitlens import registry
from visitlens.sources.views import visits

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_no_visit_is_outside_the_days(spark):
    every = visits(spark, SF_DIR).count()
    assert registry.queries()["aggr_daily_matrix"](spark, SF_DIR).agg(F.sum("n")).first()[0] == every
    timeline = registry.queries()["win_timeline_30_days"](spark, SF_DIR)
    assert timeline.columns == ["flw_id", *(f"day_{i}" for i in range(1, 31))]
    assert timeline.select(sum(F.col(c) for c in timeline.columns[1:]).alias("n")).agg(F.sum("n")).first()[0] == every
