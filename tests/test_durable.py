from __future__ import annotations

import os

from pyspark.sql import functions as F

from ripplefold import durable


def test_cuts_are_written_observed_and_deleted(spark):
    made = durable.cut(spark.range(10), F.count(F.lit(1)).alias("n"))
    assert made.metrics == {"n": 10} and made.df.count() == 10 and made.path.startswith(durable.application_folder(spark))
    made.drop()
    assert not os.path.exists(made.path.removeprefix("file://"))
    kept = durable.cut(spark.range(0))
    assert kept.df.count() == 0
    durable.forget(spark)
    assert not os.path.exists(kept.path.removeprefix("file://"))
