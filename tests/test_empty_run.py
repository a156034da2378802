"""Statistics of a cleaning run that retains no row."""

import math

from veracity.operators import clean
from veracity.plans import cleaning
from veracity.plans import queries as Q


def test_scores_of_a_run_that_retains_nothing(spark):
    rows = [(i, "T1", "C1", "Ann", "India") for i in range(3)]
    df = spark.createDataFrame(rows, "_row_id long, transaction_id string, customer_id string, customer_name string, country string")
    stats = clean.cleaning_stats(clean.clean(df, "SMART", as_of=Q.AS_OF))
    assert stats.first().rows_retained == 0 and stats.first().validity_score == 100.0
    found = cleaning.as_divided(stats).first()
    assert all(math.isnan(found[c]) for c in ("validity_score", "success_rate", "quality_score")) and found.quality_rating == "Excellent"
